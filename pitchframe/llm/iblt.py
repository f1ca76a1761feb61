"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, long ones cut further where a hash of the code points before meets a condition, so that
a cut depends on what is near it alone, in any script, and an edit changes only the pieces it touches. Each distinct paragraph's
64-bit digest is added to one cell in each third of a sketch; a cell holds a count, the digests' xor and the xor of their
checks. Subtracting one text's fingerprint from another's leaves the digests that only one of them has, and peeling
cells that hold one digest recovers them. Where peeling gets stuck the sketches are made again with twice the cells.
The likeness of two texts is the share of their paragraphs that both have.

The fingerprint is the sketch with ``CELLS`` cells, as hexadecimal text: equal texts have equal fingerprints.

Whole batches of texts are peeled together, one numpy step for all their cells.

Defined results: null text is an empty one; empty texts have the empty sketch, and two empty texts are alike (1.0); the text
after the last is the first, and a single text is its own successor; rows with equal doc_id are taken in the order of
their texts; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, table, texts

CELLS = 24
REACH = 8  #: code points that decide a cut
EVERY = 48  #: code points between cuts, on average
TOGETHER = 1_500_000  #: characters of the texts sketched at once


def paragraph_ends(text: str):
    """Positions in the text's code points behind which a paragraph ends: line ends, and where the hash of the last REACH code
    points of a line is one in EVERY. They depend on what is near them alone, in any script."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64)
    hashed = np.zeros(len(codes), np.uint32)
    for k in range(min(REACH, len(codes))):
        if len(codes) >= REACH:
            hashed[REACH - 1 :] += codes[REACH - 1 - k : len(codes) - k] * np.uint32(0x9E3779B1 * (2 * k + 1) & 0xFFFFFFFF)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    cut = (hashed >> np.uint32(12)) % np.uint32(EVERY) == 0
    cut[: REACH - 1] = False
    lines = np.flatnonzero(codes == 10)
    for k in range(REACH):  # a line's first code points do not look back into the line before
        near = lines + k
        cut[near[near < len(codes)]] = False
    cut[lines] = True
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def digests(text: str):
    """The distinct 64-bit digests of the text's paragraphs, white space at their ends dropped."""
    import numpy as np
    import xxhash

    digest, ends = xxhash.xxh3_64_intdigest, paragraph_ends(text).tolist()
    found = {digest(p) for a, b in zip([0, *ends], ends, strict=False) if (p := text[a:b].strip())}
    return np.fromiter(found, np.uint64, len(found))


def _mixed(x, salt: int):
    import numpy as np

    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Sketches:
    """Sketches of many texts side by side; text k has ``cells[k]`` cells, a multiple of three."""

    def __init__(self, cells):
        import numpy as np

        self.cells = cells
        self.first = np.cumsum(cells) - cells
        n = int(cells.sum())
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, owner, keys, sign) -> None:
        import numpy as np

        check, third = _mixed(keys, 1), self.cells[owner] // 3
        for k in range(3):
            at = self.first[owner] + k * third + (_mixed(keys, k + 2) % third.astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def part(self, lo: int, hi: int) -> "Sketches":
        """Those of texts lo .. hi-1, all of one size."""
        out, size = Sketches(self.cells[lo:hi]), int(self.cells[0]) if len(self.cells) else 0
        out.count, out.keys, out.checks = (x[lo * size : hi * size] for x in (self.count, self.keys, self.checks))
        return out

    def peel(self):
        """(owner, digest, sign) of everything recovered, and which texts' sketches are empty afterwards."""
        import numpy as np

        owner_of = np.repeat(np.arange(len(self.cells)), self.cells)
        out = []
        look = np.arange(len(self.count))
        while True:
            one = look[np.abs(self.count[look]) == 1]
            one = one[self.checks[one] == _mixed(self.keys[one], 1)]
            if not len(one):
                break
            pairs = np.stack([owner_of[one].astype(np.uint64), self.keys[one], self.count[one].view(np.uint64)])
            pairs = np.unique(pairs, axis=1) if len(one) < 2 else pairs[:, _distinct(pairs)]
            owner, keys, sign = pairs[0].astype(np.int64), pairs[1], pairs[2].view(np.int64)
            out.append((owner, keys, sign))
            self.add(owner, keys, -sign)
            look = np.flatnonzero(np.isin(owner_of, np.unique(owner)) & (self.count != 0))
        left = np.add.reduceat((self.count != 0) | (self.keys != 0), self.first) if len(self.count) else np.zeros(0)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), left == 0
        return *(np.concatenate(x) for x in zip(*out, strict=True)), left == 0


def _distinct(pairs):
    """Positions of the first of each (owner, digest)."""
    import numpy as np

    order = np.lexsort((pairs[1], pairs[0]))
    a = pairs[:2, order]
    new = np.concatenate([[True], (a[:, 1:] != a[:, :-1]).any(axis=0)])
    return order[new]


def flat(sets):
    import numpy as np

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.zeros(0, np.uint64)]), sizes


def sketched(sets: list, cells: int = CELLS) -> Sketches:
    """The sketch of ``cells`` cells of each set of digests."""
    import numpy as np

    owner, keys, _ = flat(sets)
    out = Sketches(np.full(len(sets), cells))
    out.add(owner, keys, 1)
    return out


def differing(a: list, b: list, difference: Sketches):
    """How many digests only one of a[k] and b[k] has, for each k, by peeling the ``difference`` of their sketches.

    Where peeling gets stuck, both sketches are made again with twice the cells.
    """
    import numpy as np

    found = np.zeros(len(a), np.int64)
    (owner_a, keys_a, size_a), (owner_b, keys_b, size_b) = flat(a), flat(b)
    owner, _, _, empty = difference.peel()
    counts = np.bincount(owner, minlength=len(a))
    found[empty] = counts[empty]
    todo = np.flatnonzero(~empty)
    size = 2 * difference.cells
    while (small := size < 3 * np.abs(size_a - size_b) // 2).any():  # the sizes' difference is the least that can differ
        size[small] *= 2
    while len(todo):
        place = np.full(len(a), -1)
        place[todo] = np.arange(len(todo))
        sketches = Sketches(size[todo])
        for owner, keys, sign in ((owner_a, keys_a, 1), (owner_b, keys_b, -1)):
            take = place[owner] >= 0
            sketches.add(place[owner[take]], keys[take], sign)
        owner, _, _, empty = sketches.peel()
        counts = np.bincount(owner, minlength=len(todo))
        found[todo[empty]] = counts[empty]
        todo = todo[~empty]
        size[todo] *= 2
    return found, size_a, size_b


def likeness(a: list, b: list, difference: Sketches):
    """The share of the paragraphs of a[k] or b[k] that both have; 1 where neither has any."""
    import numpy as np

    apart, size_a, size_b = differing(a, b, difference)
    total = size_a + size_b
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def written_out(sketches: Sketches) -> list[str]:
    """Each sketch as hexadecimal text: of each cell the count (4 bytes), digests and checks (8 bytes each)."""
    import numpy as np

    cells = np.zeros(len(sketches.count), [("n", ">i4"), ("keys", ">u8"), ("checks", ">u8")])
    cells["n"], cells["keys"], cells["checks"] = sketches.count, sketches.keys, sketches.checks
    raw, step = cells.tobytes(), CELLS * cells.itemsize
    return [raw[i : i + step].hex() for i in range(0, len(raw), step)]


def _place(key, cuts: list[int]):
    """How many of the rising ``cuts`` are at most ``key``, by comparing it with about 2 * sqrt(len(cuts)) of them."""

    def below(found, value):
        return F.aggregate(found, F.lit(0), lambda n, c: n + (c <= value).cast("int"))

    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    group = F.greatest(below(F.array(*(F.lit(g[0]) for g in groups)), key), F.lit(1))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group)
    return (group - 1) * step + below(inside, key)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part, follows, doc_id, text: rows dealt by ranges of doc_id, sorted, and behind each range, marked ``follows``,
    the first row of the range after it. One shuffle; the driver sees a doc_id for each range."""
    spark = docs.sparkSession
    rows = texts(docs)
    n = parts or partitions(spark)
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    key = F.coalesce("doc_id", F.lit(-(2**63))).cast("long")
    part = _place(key, cuts)
    heads = [tuple(r) for r in ids.withColumnRenamed("id", "doc_id").groupBy(part.alias("p")).agg(F.min("doc_id")).orderBy("p").collect()]
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}
    first = {p: d for p, d in heads}
    is_head, target = F.lit(False), F.lit(None).cast("int")
    if heads:
        at = F.create_map(*(x for p in first for x in (F.lit(p), F.lit(first[p]))))
        to = F.create_map(*(x for p in first for x in (F.lit(p), F.lit(before[p]))))
        is_head, target = F.element_at(at, F.col("part")) == key, F.element_at(to, F.col("part"))
    rows = rows.withColumn("part", part)
    places = F.when(
        is_head, F.array(F.struct(F.col("part"), F.lit(False).alias("follows")), F.struct(target.alias("part"), F.lit(True).alias("follows")))
    ).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("follows"))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("at")).select("at.part", "at.follows", "doc_id", "text")
    return rows.repartitionByRange(n, "part").sortWithinPartitions("part", "follows", "doc_id", "text")


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, paragraphs long"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    def sketch(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        def result(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            """Of all rows but the last, which is the last one's successor."""
            own = [digests(t) for _, t in rows]
            changed = [edited(a, b) for (_, a), (_, b) in zip(rows, rows[1:], strict=False)]
            new = [digests(t) for t in changed]
            n = len(changed)
            all_own, all_new = sketched(own), sketched(new)
            mine = all_own.part(0, n)
            near_new, near_next = likeness(own[:-1], new, mine.minus(all_new)), likeness(own[:-1], own[1:], mine.minus(all_own.part(1, n + 1)))
            rows, own = rows[:-1], own[:-1]
            columns = [
                pa.array([d for d, _ in rows], pa.int64()),
                pa.array([len(t) for _, t in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(written_out(mine)), pa.array(written_out(all_new)), pa.array(near_new), pa.array(near_next),
                pa.array([len(x) for x in own], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

        held: list[tuple[int, str]] = []
        size, now, ended = 0, None, False
        for batch in batches:
            for part, follows, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    held, size, now, ended = [], 0, part, False
                if ended:
                    continue  # further rows with the successor's doc_id
                held.append((doc_id, text))
                size += len(text)
                ended = follows
                if len(held) > 1 and (ended or size > TOGETHER):
                    yield result(held)
                    held, size = held[-1:], len(text)

    return with_next(docs).mapInArrow(sketch, RESULT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
