"""Approximate nearest neighbours on shifted space-filling curves.

Each of ``curves`` orderings turns the vectors by its own random rotation, keeps ``dims`` coordinates, shifts
them and orders the rows by position on a Hilbert curve. The order is cut into ranges of equal numbers of rows at
quantiles of a bounded sample (``sample`` vectors, those with the smallest hashes of their ids); Spark deals the rows
to the ranges. A query is sent to its own range and those around it, a ``share`` of all ranges at any size, where its
distances to all rows are computed; the best of all curves are merged and ranked. Every row is in every ordering.

Rows at one position that fills several ranges are spread over them and queries visit them all, so a common vector
fills no range; queries of a range are split into ``most_queries`` at a time. Rows pass through a task in batches, and
each task keeps only the best of each query.

Cost and recall: recall depends on the share of rows looked at, not on their number, so the work is
queries * rows * (share looked at). On vectors without any structure, whose neighbours are hardly nearer than the rest, no
share much smaller keeps nine neighbours of ten. README has the recall measured against brute force and the share.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part; vectors are compared with
those of their own length, each length being searched for itself; fewer rows than asked for give all of them; equal
distances go to the smaller id; of repeated ids the least vector counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, table

BATCH = 2048  #: rows compared with a range's queries at once


class Curves:
    """Rotations, shifts and range cuts of all orderings."""

    def __init__(self, sample, curves: int, dims: int, bits: int, ranges: int, seed: int):
        import numpy as np

        random = np.random.default_rng(seed)
        size = sample.shape[1]
        self.dims, self.bits, self.ranges = min(dims, size), bits, ranges
        self.turns = [np.linalg.qr(random.normal(size=(size, size)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = random.uniform(0, 1, (curves, self.dims))
        self.low = [(sample @ t).min(axis=0) for t in self.turns]
        self.high = [np.maximum((sample @ t).max(axis=0), low + 1e-9) for t, low in zip(self.turns, self.low, strict=True)]
        at = (np.arange(1, ranges) * len(sample) // ranges).astype(int)
        self.cuts = [np.sort(self.positions(sample, c))[at] for c in range(curves)]

    def positions(self, vectors, curve: int):
        import numpy as np

        from .hilbert import hilbert_positions

        x = (vectors @ self.turns[curve] - self.low[curve]) / (self.high[curve] - self.low[curve])
        cells = (x / 2 + self.shifts[curve] / 2) * (1 << self.bits)
        return hilbert_positions(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)

    def ranges_of(self, vectors, curve: int):
        """First and last range of each vector's position: more than one if it fills ranges alone."""
        import numpy as np

        at = self.positions(vectors, curve)
        first, last = (np.searchsorted(self.cuts[curve], at, side) for side in ("left", "right"))
        # A position that is a single cut lies at the start of the range behind it.
        return np.where(last - first > 1, first, last), last


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    curves: int = 16,
    dims: int = 8,
    bits: int = 4,
    share: float = 7 / 64,
    range_rows: int = 4096,
    sample: int = 10_000,
    most_queries: int = 8192,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of (vec_id, embedding) for which ``is_query``."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)))
    # Of rows with one id the least vector is taken, so that no id stands in a task's lists twice.
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking"))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, n, asking in sorted(map(tuple, sizes.where("asking > 0").collect())):  # a row for each length of vectors
        same = rows.where(F.size("embedding") == size)
        found = found.unionByName(_nearest(same, size, n, asking, k, curves, dims, bits, share, range_rows, sample, most_queries, seed))
    return found


def _nearest(
    rows: DataFrame, size: int, n: int, asking: int, k: int, curves: int, dims: int, bits: int, share: float,
    range_rows: int, sample: int, most_queries: int, seed: int,
) -> DataFrame:
    """The answers among ``n`` rows (vec_id, embedding, asks), each id once, whose vectors have ``size`` numbers; ``asking`` ask."""
    import numpy as np

    spark = rows.sparkSession
    result = "query_id long, vec_id long, score double"
    drawn = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["embedding"]
    # Few rows make few ranges, so that windows hold several times k rows.
    ranges = max(1, min(64, n // (4 * k)), min(sample // 20, n // range_rows))
    model = spark.sparkContext.broadcast(Curves(np.array(list(drawn)), curves, dims, bits, ranges, seed))
    beside = max(0, int(np.ceil((share * ranges - 1) / 2)))  # at least the share, however many ranges there are
    parts = max(1, -(-asking * (2 * beside + 1) // ranges // most_queries))

    def place(batches: Iterator) -> Iterator:
        """Each row once for each curve, and each query once for each curve and range that it looks at."""
        import pyarrow as pa

        curves_ = model.value
        for batch in batches:
            if not len(batch):
                continue
            ids, asks = batch.column("vec_id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            flat = np.asarray(batch.column("embedding").flatten())
            x = flat.reshape(len(ids), size)
            out = []  # curve, range, part, asks, row
            for c in range(curves):
                first, last = curves_.ranges_of(x, c)
                own = first + ids % (last - first + 1)
                every = np.arange(len(ids))
                for part in range(parts):
                    out.append((np.full(len(ids), c), own, np.full(len(ids), part), np.zeros(len(ids), bool), every))
                q = np.flatnonzero(asks)
                lo, hi = np.maximum(first[q] - beside, 0), np.minimum(last[q] + beside, ranges - 1)
                times = hi - lo + 1
                who = np.repeat(q, times)
                at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out.append((np.full(len(who), c), at, (who * 7919 + ids[who]) % parts, np.ones(len(who), bool), who))
            c, r, p, a, who = (np.concatenate(z) for z in zip(*out, strict=True))
            for lo in range(0, len(who), 20_000):
                cut = slice(lo, lo + 20_000)
                packed = [v.tobytes() for v in x[who[cut]].astype("<f8")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c[cut].astype(np.int32)), pa.array(r[cut].astype(np.int32)), pa.array(p[cut].astype(np.int32)),
                        pa.array(a[cut]), pa.array(ids[who[cut]]), pa.array(packed, pa.binary()),
                    ],
                    ["curve", "range", "part", "asks", "vec_id", "vector"],
                )

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[int, tuple] = {}  # by query: (ids, scores), nearest first
        held = {"key": None, "ids": [], "x": []}

        def answers() -> pa.RecordBatch:
            got = [(q, v, s) for q, (ids, scores) in best.items() for v, s in zip(ids, scores, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        def compare(ids, x) -> None:
            queries, q = np.array(held["ids"]), held["matrix"]
            squares = (x**2).sum(axis=1)
            near = (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T) + squares[None]
            limit = np.partition(near, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
            slack = 1e-9 * (squares.max() + 1)
            for i, query in enumerate(queries.tolist()):
                take = np.flatnonzero(near[i] <= limit[i] + slack)
                take = take[ids[take] != query]
                scores = np.sqrt(((x[take] - q[i]) ** 2).sum(axis=1))
                old_ids, old_scores = best.get(query, (np.zeros(0, np.int64), np.zeros(0)))
                all_ids, all_scores = np.concatenate([old_ids, ids[take]]), np.concatenate([old_scores, scores])
                all_ids, where = np.unique(all_ids, return_index=True)
                all_scores = all_scores[where]
                order = np.lexsort((all_ids, all_scores))[:k]
                best[query] = (all_ids[order], all_scores[order])

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            asks, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy()
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<f8").reshape(len(ids), size)
            edges = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in [*keys, asks.astype(int)]])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                key = tuple(int(c[lo]) for c in keys)
                if key != held["key"]:
                    if len(best) > 4 * most_queries:
                        yield answers()
                        best.clear()
                    held.update(key=key, ids=[], x=[], matrix=None)
                if asks[lo]:
                    held["ids"] += ids[lo:hi].tolist()
                    held["x"].append(x[lo:hi])
                elif held["ids"]:
                    if held["matrix"] is None:
                        held["matrix"] = np.concatenate(held["x"])
                    for at in range(lo, hi, BATCH):
                        compare(ids[at : min(at + BATCH, hi)], x[at : min(at + BATCH, hi)])
        if best:
            yield answers()

    placed = rows.mapInArrow(
        place, "curve int, range int, part int, asks boolean, vec_id long, vector binary"
    )
    keys = ["curve", "range", "part"]
    dealt = placed.repartition(max(partitions(spark), curves * 4), *keys)
    found = dealt.sortWithinPartitions(*keys, F.desc("asks"), "vec_id").mapInArrow(search, result)
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
