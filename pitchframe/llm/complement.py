"""Best-fit packing by exact complements: whole documents into as few sequences of at most ``capacity`` tokens as can be.

Only how many pieces there are of each length decides how they are packed, and there are at most ``capacity`` lengths. So
pieces are counted by length in Spark, ``plan`` packs the counts, and each piece finds its place by its rank among the
pieces of its length. The plan takes the longest length left and looks its gap up in indexes of sums: one length, two, or
three that fill it exactly, as often as the counts allow; what no combination fills goes by best fit. It works on counts,
so its size depends on the capacity alone, however many documents there are.

Ranks need no sort and no key: a task numbers its own pieces of each length as it encodes them, and the counts of the
tasks in front are added. A length that most pieces have is spread over all tasks.

Defined results: a document of more than ``capacity`` tokens is cut into pieces of exactly that many, of which the first may be
shorter; null text is an empty document (its end id alone); a very long text is one row in memory, as it is in the table;
repeated rows and rows with equal doc_id are packed once each; a null doc_id is kept; pieces of equal length may take each
other's places from run to run; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts, written

WORDS, CHARACTERS = 640_000, 8_000_000  #: chunks whose ids a worker keeps, and characters that it splits at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
PLACED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


class Complements:
    """Lengths still to be had, by their own length and by the sum of two, longest first.

    A sum's entries are walked by a cursor: counts only fall, so an entry that has run out never comes back.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = Counter({n: c for n, c in counts.items() if c > 0 and n > 0})
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lengths = sorted(self.left, reverse=True)
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < capacity:
                    self.pairs[a + b].append((a, b))
        self.cursor: Counter = Counter()

    def times(self, parts: tuple[int, ...]) -> int:
        """How many sequences of exactly these lengths there are pieces for."""
        return min(self.left[n] // parts.count(n) for n in set(parts))

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        found, at = self.pairs.get(total, ()), self.cursor[total]
        while at < len(found) and not self.times(found[at]):
            at += 1
        self.cursor[total] = at
        return next((p for p in found[at:] if self.times((*beside, *p))), None)

    def filling(self, longest: int, capacity: int) -> tuple[int, ...] | None:
        """``longest`` and the fewest others, at most three, that fill a sequence exactly; None if none do."""
        gap = capacity - longest
        if not gap:
            return (longest,)
        if self.left[gap] and self.times((longest, gap)):
            return (longest, gap)
        if pair := self.pair(gap, (longest,)):
            return (longest, *pair)
        for a in sorted((n for n in self.left if n < gap and self.left[n]), reverse=True):
            if self.times((longest, a)) and (pair := self.pair(gap - a, (longest, a))):
                return (longest, a, *pair)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences): all pieces, packed."""
    index = Complements(counts, capacity)
    made: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}
    for longest in sorted(index.left, reverse=True):
        while index.left[longest] and (parts := index.filling(longest, capacity)):
            n = index.times(parts)
            for part in parts:
                index.left[part] -= n
            made.append((parts, n))
        if index.left[longest]:  # no piece that is left fills its gap; shorter ones may still be needed elsewhere
            rest[longest], index.left[longest] = index.left[longest], 0
    return made + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The same by best-fit decreasing: each piece to the fullest sequence with room, equal sequences taken together."""
    rooms: dict[int, list[list]] = defaultdict(list)  # by room: sequences alike and how many
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            parts, there = rooms[room].pop() if room is not None else [(), -(-left // (capacity // n))]
            room = capacity if room is None else room
            each = min(room // n, left)  # a sequence takes pieces of this length until none fits
            used = min(there, left // each)
            rooms[room - each * n].append([(*parts, *[n] * each), used])
            if there > used and parts:
                rooms[room].append([parts, there - used])
            left -= used * each
    return [(tuple(parts), n) for room in rooms.values() for parts, n in room]


class Places:
    """Sequence and offset of the piece of a given length and rank, by a plan."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        import numpy as np

        slots, ranks, first = defaultdict(list), Counter(), 0
        for parts, n in made:
            offset, total = 0, sum(parts)
            for length in parts:
                slots[length].append((ranks[length], first, offset, total))
                ranks[length] += n
                offset += length
            first += n
        self.slots = {length: np.array(rows, np.int64).T for length, rows in slots.items()}

    def of(self, lengths, ranks):
        import numpy as np

        sequence, offset, total = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            start, first, at, filled = self.slots[int(length)]
            k = np.searchsorted(start, ranks[here], "right") - 1
            sequence[here], offset[here], total[here] = first[k] + ranks[here] - start[k], at[k], filled[k]
        return sequence, offset, total


def pack(docs: DataFrame, vocabulary: str, spaced: bool = True, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    ``vocabulary``: path of a file of the tokenizers library, present on every worker. ``spaced``: whether it joins a space to
    the word behind it (byte-level vocabularies). The driver holds the counts by length and the plan, a few numbers for each of
    at most ``capacity`` lengths.
    """

    def measure(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        words, end, task, seen = encoder(vocabulary, spaced, WORDS, CHARACTERS), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), Counter()
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, piece, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), n, task, seen[hi - lo]))
                    seen[hi - lo] += 1
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = [pa.int32() if c in ("piece", "task") else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = written(rows.mapInArrow(measure, PIECES), "pieces")  # written, so that ranks stay as they were given
    held = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(counts, capacity))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens")]
            found = [pa.array(x) for x in places.of(lengths, ranks)]
            yield pa.RecordBatch.from_arrays([*own, *found], [f.split()[0] for f in PLACED.split(", ")])

    # A row for each task and length; of one length a row for each task.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    return ranked.mapInArrow(place, PLACED)


def op11_complement_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
