"""Vector codes: product quantisation, its codebooks fitted by Lloyd's rounds with partition-local heaps.

Vectors become integers and are cut into ``PARTS`` equal parts; each part position has a codebook of up to ``ENTRIES``
entries. Rows are gathered into blocks, each one row of a table with the integers of its vectors, and each round reads and
writes that table. A block has, for every entry of every codebook, a heap of the parts assigned to it. A part's key is its
slack when it was last scanned (the distance to the second nearest entry less that to its own), plus all that the entry had
drifted by then: each round adds to an entry how far it moved and how far any other one did. While an entry's drift is below a
key, the part cannot have come nearer to another entry. So a round pops from each heap only those parts whose key the drift has
reached, scans these exactly against all entries and pushes them onto the heap of the nearest; the others are not looked at. Sums and
counts change by the parts that moved alone.

All arithmetic that decides a result is on integers; distances in doubles only tell which parts to leave alone, with a margin
above their rounding. The driver holds codebooks, their sums and drifts, whose size is that of ``ENTRIES`` vectors. A lost
task is run again from the table of the round before; the table before that is deleted.

Defined results: vectors that are null, or hold null or non-finite components, have no row; nor have vectors of another length than
the first one kept, by vec_id (one table has one kind of vector). A length that ``PARTS`` does not divide leaves the last components
out of all parts. Components are held at ``LARGEST`` either way, so that distances fit a long. Of equal vec_ids the
smaller components come first, and all rows have a code; null vec_ids come last. Fewer rows than ``ENTRIES`` give fewer entries,
and an entry of equal vectors stays unused, as ties go to the lower index. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, partitions, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26
ROWS = 4096  #: vectors of a block, or fewer, so that it holds at most
CELLS = 1 << 20  #: components
#: ids and labels of the block's rows, integers of its vectors, heaps one behind the other: how many parts each has, keys, rows.
BLOCK = "ids array<long>, labels array<string>, width byte, vectors binary, sizes binary, keys binary, members binary, task_sums array<long>"
MARGIN = 1e-6


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: Column) -> Column:
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return F.transform(vector, whole)


class Codebooks:
    """Entries of every part position, and how far each has drifted since the first round."""

    def __init__(self, first):
        import numpy as np

        n, length = first.shape
        self.size = length // PARTS
        self.entries = first[:, : PARTS * self.size].reshape(n, PARTS, self.size).transpose(1, 0, 2).copy()
        self.drift = np.zeros((PARTS, n))
        self.totals = np.zeros((PARTS, n, self.size + 1), np.int64)  # componentwise sums, and counts

    def moved(self, change) -> None:
        """The next entries, after sums and counts changed by ``change``."""
        import numpy as np

        self.totals = self.totals + change
        count = self.totals[:, :, -1:]
        after = np.where(count > 0, self.totals[:, :, :-1] // np.maximum(count, 1), self.entries)
        step = np.sqrt(((after - self.entries).astype(np.float64) ** 2).sum(axis=2))
        order = np.sort(step, axis=1)
        most = np.where(step == order[:, -1:], order[:, -2:-1] if step.shape[1] > 1 else 0, order[:, -1:])  # of the other entries
        if step.shape[1] > 1:
            most = np.where((step == order[:, -1:]).sum(axis=1, keepdims=True) > 1, order[:, -1:], most)
        self.drift = self.drift + step + most
        self.entries = after

    def scanned(self, parts, position: int):
        """Of each part the nearest entry, its squared distance, and the slack to the second nearest."""
        import numpy as np

        far = np.stack([((parts - e) ** 2).sum(axis=1) for e in self.entries[position]], axis=1)
        nearest = far.argmin(axis=1)
        least = np.take_along_axis(far, nearest[:, None], 1)[:, 0]
        np.put_along_axis(far, nearest[:, None], np.iinfo(np.int64).max, 1)
        return nearest, least, np.sqrt(far.min(axis=1).astype(np.float64)) - np.sqrt(least.astype(np.float64))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class Heaps:
    """A block's heaps, one for each entry of each part position: (key, row) pairs, least key first."""

    def __init__(self, n: int):
        self.n, self.of = n, [[[] for _ in range(ENTRIES)] for _ in range(PARTS)]

    @classmethod
    def load(cls, block: dict) -> "Heaps":
        import numpy as np

        found = cls(len(block["ids"]))
        keys, members = np.frombuffer(block["keys"]).tolist(), np.frombuffer(block["members"], np.uint16).tolist()
        at = 0
        for i, size in enumerate(np.frombuffer(block["sizes"], np.uint16).tolist()):
            found.of[i // ENTRIES][i % ENTRIES] = list(zip(keys[at : at + size], members[at : at + size], strict=True))
            at += size
        return found

    def saved(self) -> dict:
        import numpy as np

        heaps = [h for position in self.of for h in position]
        keys, members = (np.array([x[i] for h in heaps for x in h], kind) for i, kind in ((0, np.float64), (1, np.uint16)))
        return {"sizes": np.array([len(h) for h in heaps], np.uint16).tobytes(), "keys": keys.tobytes(), "members": members.tobytes()}

    def renew(self, vectors, books: Codebooks):
        """Pop the parts that may have come nearer to another entry, scan them, push them; change of sums and counts."""
        import numpy as np

        change = np.zeros_like(books.totals)
        for p, heaps in enumerate(self.of):
            popped, before = [], []
            for j, heap in enumerate(heaps):
                while heap and heap[0][0] <= books.drift[p][j]:
                    popped.append(heapq.heappop(heap)[1])
                    before.append(j)
            if popped:
                self._push(p, vectors, books, np.array(popped), np.array(before), change)
        return change

    def first(self, vectors, books: Codebooks):
        import numpy as np

        change = np.zeros_like(books.totals)
        for p in range(PARTS):
            self._push(p, vectors, books, np.arange(self.n), None, change)
        return change

    def _push(self, p, vectors, books, rows, before, change) -> None:
        import numpy as np

        parts = vectors[rows, p]
        nearest, _, slack = books.scanned(parts, p)
        slack -= MARGIN * (1 + np.abs(slack))
        for j, key, row in zip(nearest.tolist(), (slack + books.drift[p][nearest]).tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.of[p][j], (key, row))
        counted = np.concatenate([parts, np.ones((len(parts), 1), np.int64)], axis=1)
        np.add.at(change[p], nearest, counted)
        if before is not None:
            np.subtract.at(change[p], before, counted)

    def codes(self):
        import numpy as np

        out = np.zeros((self.n, PARTS), np.int64)
        for p, heaps in enumerate(self.of):
            for j, heap in enumerate(heaps):
                out[[row for _, row in heap], p] = j
        return out


def _vectors(block: dict, size: int):
    """A block's vectors as (row, part, component)."""
    import numpy as np

    flat = np.frombuffer(block["vectors"], f"<i{block['width']}").astype(np.int64)
    return flat.reshape(len(block["ids"]), PARTS, size)


def _batch(blocks: list[dict]):
    import pyarrow as pa

    kinds = {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "byte": pa.int8(), "binary": pa.binary()}
    fields = [f.split() for f in BLOCK.split(", ")]
    return pa.RecordBatch.from_pylist(blocks, pa.schema([(name, kinds[kind]) for name, kind in fields]))


def _blocks(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (vec_id, label, vector) gathered into blocks with heaps by the first codebooks; ``task_sums`` is null but in a task's last row."""
    length = PARTS * books.size

    def gather(batches: Iterator) -> Iterator:
        import numpy as np

        change, n = np.zeros_like(books.totals), min(ROWS, max(1, CELLS // max(1, length)))
        for batch in batches:
            for lo in range(0, batch.num_rows, n):
                part = batch.slice(lo, n)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)[:, :length]
                width = 2 if not flat.size or np.abs(flat).max() < 1 << 15 else 4
                block = {"ids": part.column("vec_id").to_pylist(), "labels": part.column("label").to_pylist(), "width": width, "vectors": flat.astype(f"<i{width}").tobytes()}
                heaps = Heaps(part.num_rows)
                change += heaps.first(_vectors(block, books.size), books)
                yield _batch([block | heaps.saved()])
        yield _batch([{"task_sums": change.reshape(-1).tolist()}])

    return rows.mapInArrow(gather, BLOCK)


def _renewed(blocks: DataFrame, books: Codebooks) -> DataFrame:
    def renew(batches: Iterator) -> Iterator:
        import numpy as np

        change = np.zeros_like(books.totals)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                heaps = Heaps.load(block)
                change += heaps.renew(_vectors(block, books.size), books)
                yield _batch([block | heaps.saved()])
        yield _batch([{"task_sums": change.reshape(-1).tolist()}])

    return blocks.where("ids IS NOT NULL").mapInArrow(renew, BLOCK)


def _coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                vectors, codes = _vectors(block, books.size), Heaps.load(block).codes()
                nearest = np.stack([books.entries[p][codes[:, p]] for p in range(PARTS)], axis=1)
                error = ((vectors - nearest) ** 2).sum(axis=(1, 2))
                hexes = ["".join(f"{j:02x}" for j in row) for row in codes.tolist()]
                columns = [pa.array(block["ids"], pa.int64()), pa.array(block["labels"], pa.string()), pa.array(hexes), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.where("ids IS NOT NULL").mapInArrow(code, "vec_id long, label string, code string, error long")


def _change(blocks: DataFrame, books: Codebooks):
    """The tasks' changes of sums and counts, added up in Spark: as many numbers as the codebooks have."""
    import numpy as np

    each = blocks.where("task_sums IS NOT NULL").select(F.posexplode("task_sums").alias("i", "x"))
    out = np.zeros(books.totals.size, np.int64)
    for r in each.groupBy("i").agg(F.sum("x").alias("x")).where("x <> 0").collect():
        out[r["i"]] = r["x"]
    return out.reshape(books.totals.shape)


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label as text, code, error) of every usable vector, as a written table, and the codebooks; (no rows, None) without any."""
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), integers(F.col(vector)).alias("vector"))
    order = [F.asc_nulls_last("vec_id"), "vector"]
    length = rows.orderBy(*order).select(F.size("vector").alias("n")).first()
    if length is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), None
    rows = rows.where(F.size("vector") == length["n"])
    first = rows.orderBy(*order).limit(ENTRIES).collect()
    books = Codebooks(np.array([r["vector"] for r in first], np.int64).reshape(len(first), -1))

    paths, blocks = [], _blocks(rows, books)
    for k in range(rounds + 1):
        paths.append(new_path(spark, "vector-blocks"))
        blocks.write.option("compression", "zstd").parquet(paths[-1])
        held = spark.read.schema(blocks.schema).parquet(paths[-1])
        for old in paths[:-1]:  # what the table just written was made from
            _delete(spark, old)
        del paths[:-1]
        if k < rounds:
            books.moved(_change(held, books))
            blocks = _renewed(held, books)
    out = written(_coded(held, books), "vector-codes")
    _delete(spark, paths[-1])
    return out, books


def _delete(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the error summed over rows of one label, nulls together. A common label's rows are dealt out by salt."""
    salts = 4 * partitions(coded.sparkSession)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = coded.withColumn("_dealt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    met = rows.join(sums, rows["label"].eqNullSafe(sums["_label"]) & (rows["_dealt"] == sums["_salt"]))
    return met.select(*coded.columns, "label_error")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = books.digest() if books else None
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds one behind the other, by brute force: every part against every entry."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT row, q.p, e, list_sum(list_transform(list_zip(q.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts q JOIN book{k} b ON q.p = b.p)
  GROUP BY row, p)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (
  SELECT p, e, list(x ORDER BY i) AS part FROM (
    SELECT p, e, i, floor(sum(q.part[i])::DOUBLE / count(*))::BIGINT AS x FROM near{k} JOIN parts q USING (row, p), range(1, (SELECT max(size) FROM kept) + 1) r(i) GROUP BY p, e, i)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.part, b.part) AS part FROM book{k} b LEFT JOIN sums{k} s USING (p, e))""")
    return ",".join(steps)


CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS row, vec_id, label, v, len(v) // {PARTS} AS size FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT row, p, v[p * size + 1 : (p + 1) * size] AS part FROM kept, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, part FROM parts WHERE row <= {ENTRIES}),{_rounds_sql()},
digest AS (SELECT sha256(string_agg(list_aggregate(part, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest
"""
