"""A context-mixing range coder for token ids, coding many independent blocks in step.

Each block starts from empty models. Three models predict a block's next id: the id last seen after the
same two ids (order 2), the one after the same id (order 1), and the block's own counts of id bytes
(order 0). The confidences of orders 2 and 1 each give counts of {order 2 is right, order 1 is right,
neither}; their sum, a mixture weighted by evidence, drives the arithmetic coder, and an id that neither
predicts is coded byte by byte with the order-0 counts. numpy carries out one step of all blocks at once.

The coder keeps ranges of 32 to 48 bits and moves 16 bits at a time, so a symbol moves at most one digit;
carries are kept in the digits and added in at the end of a block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048  #: ids in a block; counts stay below 2**16 up to here
LANES = 2048  #: blocks coded in step, which bounds the memory of the models
SLOTS = 2048  #: contexts that a block remembers for order 1, and for order 2
LOW_BYTE_GROUPS = 4  #: the low byte has counts of its own for each of the high bytes 0, 1, 2 and the rest
LARGEST = (1 << 30) - 1  #: id
HEADER = struct.Struct("<4sBBHIIQI")
MAGIC, VERSION = b"PFTK", 2
SEEN, SEEN_BYTE = 12, 24  #: what an occurrence adds to a count
_16, _32 = np.uint64(16), np.uint64(32)
_FIELD = np.uint64(0xFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_LEAST = np.uint64(1 << 32)
_FULL = np.uint64((1 << 48) - 1)
_SUMS = np.uint64(1 | 1 << 16 | 1 << 32)  #: times three counts in 16-bit fields: their running sums
_EQUAL = np.array([0xFFFFFFFFFFFF, 0xFFFF0000FFFF], np.uint64)  #: no count for order 1 where it says what order 2 says
_SHIFT = np.array([0, 16, 32], np.uint64)
_ADD = np.uint64(SEEN) << _SHIFT


class _Models:
    """The three models of ``lanes`` blocks. A slot holds id * 4 + confidence; counts are three 16-bit fields of a number."""

    def __init__(self, lanes: int, planes: int):
        self.slots = [np.zeros(lanes * SLOTS, np.uint32) for _ in range(2)]
        self.right = [np.full(lanes * 4, _SUMS, np.uint64) for _ in range(2)]
        self.slot_base, self.right_base = np.arange(lanes) * SLOTS, np.arange(lanes) * 4
        self.kinds = LOW_BYTE_GROUPS + max(0, planes - 1)
        self.counts = np.ones((lanes, self.kinds, 256), np.int32)
        self.sums = np.zeros((lanes, self.kinds, 257), np.int32)
        self.flat_counts, self.flat_sums = self.counts.reshape(-1), self.sums.reshape(-1)
        self.last, self.older = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.refresh()

    def refresh(self) -> None:
        np.cumsum(self.counts, axis=2, out=self.sums[:, :, 1:])

    def predict(self, n: int):
        """Of the first n blocks: the ids that order 2 and order 1 expect, and the mixed counts."""
        mixed = self.last[:n] * 40503
        one = self.slot_base[:n] + ((mixed >> 3) & (SLOTS - 1))
        two = self.slot_base[:n] + ((mixed ^ (self.older[:n] * 30011 + 77)) & (SLOTS - 1))
        held = self.slots[0].take(one), self.slots[1].take(two)
        sure = held[0] & 3, held[1] & 3
        places = self.right_base[:n] + sure[0], self.right_base[:n] + sure[1]
        counts = self.right[0].take(places[0]), self.right[1].take(places[1])
        guess = held[0] >> 2, held[1] >> 2
        self.now = (one, two), held, sure, places, counts, guess
        return guess[1], guess[0], (counts[0] + counts[1]) & _EQUAL.take((guess[0] == guess[1]).view(np.uint8))

    def learn(self, n: int, ids, symbol) -> None:
        """``ids`` (uint32) came, and ``symbol`` says who was right."""
        at, held, sure, places, counts, guess = self.now
        add, fresh = _ADD.take(symbol), ids << 2
        for k in (0, 1):
            self.right[k][places[k]] = counts[k] + add
            less = np.where(sure[k] > 0, held[k] - 1, fresh)
            self.slots[k][at[k]] = np.where(guess[k] == ids, held[k] + (sure[k] < 3), less)
        self.older[:n] = self.last[:n]
        self.last[:n] = ids

    def rows(self, which, plane: int, high):
        """Numbers of the rows of byte counts: the low byte's depend on the byte above it."""
        kind = np.minimum(high, LOW_BYTE_GROUPS - 1) if plane == 0 else LOW_BYTE_GROUPS + plane - 1
        return which * self.kinds + kind


def _due(step: int) -> bool:
    """Whether byte counts take effect before this step."""
    return step in (8, 16, 32, 64) or step % 128 == 0 and step > 0


def _parts(mixed, symbol):
    """(sum of the counts below the symbol's, its count)."""
    shift = _SHIFT.take(symbol)
    return ((mixed * _SUMS << _16) >> shift) & _FIELD, (mixed >> shift) & _FIELD


def _total(mixed):
    return (mixed * _SUMS >> _32) & _FIELD


def _encode_lanes(ids, sizes, planes: int) -> list[bytes]:
    """ids[step, lane] (uint32); sizes: ids of each lane, none larger than the one before it."""
    lanes, steps = len(sizes), int(sizes[0])
    models = _Models(lanes, planes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    width = (planes + 1) * steps + 3
    out, at = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width

    def put(where, below, count, total) -> None:
        part = span[where] // total
        lo, sp = low[where] + below * part, part * count
        go = np.flatnonzero(sp < _LEAST)
        low[where], span[where] = lo, sp
        if len(go):
            moved = lo[go]
            rows = go if isinstance(where, slice) else where[go]
            place = at[rows]
            out[place] = moved >> _32
            at[rows] = place + 1
            low[rows], span[rows] = (moved & _LOW) << _16, sp[go] << _16

    n = lanes
    for step in range(steps):
        while sizes[n - 1] <= step:
            n -= 1
        if _due(step):
            models.refresh()
        now = ids[step, :n]
        two, one, mixed = models.predict(n)
        symbol = np.where(now == two, 0, 2 - (now == one))
        put(slice(0, n), *_parts(mixed, symbol), _total(mixed))
        rest = np.flatnonzero(symbol == 2)
        if len(rest):
            values, high = now[rest].astype(np.int64), None
            for plane in range(planes - 1, -1, -1):
                byte = (values >> (8 * plane)) & 255
                row = models.rows(rest, plane, high)
                first = row * 257
                below = models.flat_sums.take(first + byte)
                count = models.flat_sums.take(first + byte + 1) - below
                put(rest, below.astype(np.uint64), count.astype(np.uint64), models.flat_sums.take(first + 256).astype(np.uint64))
                models.flat_counts[row * 256 + byte] += SEEN_BYTE
                high = byte
        models.learn(n, now, symbol)
    for _ in range(3):
        out[at] = low >> _32
        at += 1
        low = (low & _LOW) << _16
    used = at - np.arange(lanes) * width
    digits, carry = out.reshape(lanes, width)[:, : used.max()], np.zeros(lanes, np.uint32)
    for k in range(digits.shape[1] - 1, -1, -1):
        whole = digits[:, k] + carry
        digits[:, k], carry = whole & 0xFFFF, whole >> 16
    return [digits[k, : used[k]].astype("<u2").tobytes() for k in range(lanes)]


def _decode_lanes(data: list[bytes], sizes, planes: int):
    """ids[step, lane] (uint32) of the blocks that ``_encode_lanes`` gave."""
    lanes, steps = len(sizes), int(sizes[0])
    models = _Models(lanes, planes)
    width = max(map(len, data)) // 2 + 4
    source = np.frombuffer(b"".join(d.ljust(2 * width, b"\0") for d in data), "<u2").astype(np.uint64)
    at = np.arange(lanes) * width
    end = at + width - 1
    span, code = np.full(lanes, _FULL), np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << _16) | source[at]
        at += 1
    ids = np.zeros((steps, lanes), np.uint32)

    def value(where, total):
        part = span[where] // total
        return np.minimum(code[where] // np.maximum(part, 1), total - np.uint64(1)), part

    def take(where, part, below, count) -> None:
        c, sp = code[where] - below * part, part * count
        go = np.flatnonzero(sp < _LEAST)
        code[where], span[where] = c, sp
        if len(go):
            rows = go if isinstance(where, slice) else where[go]
            place = np.minimum(at[rows], end[rows])  # damaged data may ask for more
            code[rows], span[rows] = (c[go] << _16) | source[place], sp[go] << _16
            at[rows] = place + 1

    n = lanes
    for step in range(steps):
        while sizes[n - 1] <= step:
            n -= 1
        if _due(step):
            models.refresh()
        two, one, mixed = models.predict(n)
        every = slice(0, n)
        v, part = value(every, _total(mixed))
        sums = mixed * _SUMS
        symbol = (v >= (sums & _FIELD)).astype(np.int64) + (v >= (sums >> _16 & _FIELD))
        take(every, part, *_parts(mixed, symbol))
        now = np.where(symbol == 0, two, one)
        rest = np.flatnonzero(symbol == 2)
        if len(rest):
            values, high = np.zeros(len(rest), np.int64), None
            for plane in range(planes - 1, -1, -1):
                row = models.rows(rest, plane, high)
                first = row * 257
                v, part = value(rest, models.flat_sums.take(first + 256).astype(np.uint64))
                v = v.astype(np.int32)
                spot = first.copy()
                for bit in (128, 64, 32, 16, 8, 4, 2, 1):
                    spot += bit * (models.flat_sums.take(spot + bit) <= v)
                below = models.flat_sums.take(spot)
                count = models.flat_sums.take(spot + 1) - below
                take(rest, part, below.astype(np.uint64), count.astype(np.uint64))
                byte = spot - first
                models.flat_counts[row * 256 + byte] += SEEN_BYTE
                values |= byte << (8 * plane)
                high = byte
            now[rest] = values
        ids[step, :n] = now
        models.learn(n, now, symbol)
    return ids


def _groups(blocks: int) -> list[tuple[int, int]]:
    """Blocks to code in step: as few groups as LANES allows, of like sizes."""
    parts = -(-blocks // LANES)
    edges = [blocks * k // parts for k in range(parts)] + [blocks]
    return list(zip(edges, edges[1:], strict=False))


def encode_segment(doc_ids, lengths, ids, block: int = BLOCK) -> bytes:
    """One self-contained piece of a token file: whole documents, their ids in blocks of ``block``."""
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} ids")
    top = int(ids.max()) if len(ids) else 0
    if top > LARGEST:
        raise ValueError(f"an id is over {LARGEST}")
    planes = max(2, (top.bit_length() + 7) // 8)
    blocks = -(-len(ids) // block)
    sizes = np.minimum(block, len(ids) - block * np.arange(blocks))
    grid = np.zeros(blocks * block, "<u4")
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, block)
    coded: list[bytes] = []
    for lo, hi in _groups(blocks):
        coded += _encode_lanes(np.ascontiguousarray(grid[lo:hi].T), sizes[lo:hi], planes)
    sums = [zlib.crc32(grid[k, : sizes[k]]) for k in range(blocks)]
    head = b"".join(
        [
            doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(),
            np.array([len(c) for c in coded], "<u4").tobytes(), np.array(sums, "<u4").tobytes(),
        ]
    )
    first = HEADER.pack(MAGIC, VERSION, planes, block, len(doc_ids), blocks, len(ids), zlib.crc32(head))
    return b"".join([first, head, *coded])


def decode_segment(data: bytes):
    """(doc_ids, lengths, ids as little-endian uint32); ValueError if a checksum does not hold."""
    if len(data) < HEADER.size:
        raise ValueError("not a token segment")
    magic, version, planes, block, docs, blocks, n, check = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a token segment of version {VERSION}")
    head = data[HEADER.size : HEADER.size + 16 * docs + 8 * blocks]
    if zlib.crc32(head) != check or len(head) != 16 * docs + 8 * blocks:
        raise ValueError("the segment's header is damaged")
    doc_ids, lengths = np.frombuffer(head, "<i8", docs), np.frombuffer(head, "<u8", docs, 8 * docs).astype(np.int64)
    if not blocks:
        return doc_ids, lengths, np.zeros(0, "<u4")
    bytes_of, sums = (np.frombuffer(head, "<u4", blocks, 16 * docs + 4 * blocks * k) for k in (0, 1))
    ends = HEADER.size + len(head) + np.cumsum(bytes_of.astype(np.int64))
    coded = [data[end - size : end] for end, size in zip(ends.tolist(), bytes_of.tolist(), strict=True)]
    sizes = np.minimum(block, n - block * np.arange(blocks))
    out = []
    for lo, hi in _groups(blocks):
        grid = np.ascontiguousarray(_decode_lanes(coded[lo:hi], sizes[lo:hi], planes).T, "<u4")
        for k, row in enumerate(grid, lo):
            if zlib.crc32(row[: sizes[k]]) != sums[k]:
                raise ValueError(f"block {k} of the segment is damaged")
        out.append(np.pad(grid, ((0, 0), (0, block - grid.shape[1]))).reshape(-1) if grid.shape[1] < block else grid.reshape(-1))
    return doc_ids, lengths, np.concatenate(out)[:n]
