"""Ingested files as versioned tables: raw rows, rejects and deliveries of each version, and a manifest that says which one holds.

A version's tables are written first; the manifest's row, appended last, makes them the ones that readers see. A failed load or merge appends
its own row and leaves the tables of the last good version in place. A file that is unchanged since its last good load is skipped, and
so is one whose contents are the same under a new time stamp.

A merge writes the seasons that it touches and nothing else: its manifest row says, season by season, which version's files hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import timeline_key
from . import ingest, records

TABLES = ("raw", "rejects", "deliveries")
MANIFEST = (
    "source string, bytes long, modified timestamp, content_hash string, schema_hash string, status string, message string, version string, "
    "n_raw long, n_rejected long, n_accepted long, loaded string, seasons map<int,string>, loaded_at timestamp"
)
#: Of a load's tables; a merged version's deliveries too.
DELIVERIES = ", ".join(
    [f"{c} int" for c in (*ingest.INTEGERS, *ingest.BOOLEANS)] + [f"{c} string" for c in ingest.TEXTS] + ["source_row_number long", "legal_ball int", "timeline_key string"]
)
MODULUS, BASE = (1 << 61) - 1, 1_000_003  #: of the hash of lines


_HELD = ("content_hash", "schema_hash", "version", "n_raw", "n_rejected", "n_accepted", "loaded", "seasons")


@dataclass(frozen=True)
class Load:
    version: str | None
    skipped: bool
    n_raw: int
    n_rejected: int
    n_accepted: int


def file_state(spark: SparkSession, path: str) -> Row:
    """Resolved path, bytes and time of change, of all files together, without reading them."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.min("path").alias("source"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified")).first()


def content_hash(spark: SparkSession, path: str) -> str:
    """A hash of the files' lines in their order, the same however the files are cut into splits.

    A run of lines hashes to (hash, length), its lines being digits of a number in base BASE, so two runs behind each other hash to
    (first * BASE ** second's length + second, both lengths). Tasks hash their splits; each split then counts by the power of all lines behind it.
    """

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line")), strict=True):
                run = runs.setdefault((file, start), [0, 0])
                run[0] = (run[0] * BASE + line % MODULUS + 1) % MODULUS
                run[1] += 1
        rows = [(*k, *v) for k, v in runs.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "start", "hash", "lines"])

    def powered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            each = zip(batch.column("hash").to_pylist(), batch.column("behind").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([h * pow(BASE, n, MODULUS) % MODULUS for h, n in each], pa.int64())], ["hash"])

    lines = records.lines(spark, path).select("file", "start", F.xxhash64("value").alias("line"))
    splits = lines.mapInArrow(hashed, "file string, start long, hash long, lines long")
    behind = Window.orderBy(F.desc("file"), F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    placed = splits.select("hash", F.coalesce(F.sum("lines").over(behind), F.lit(0)).alias("behind"))
    total = placed.mapInArrow(powered, "hash long").agg(F.sum(F.col("hash").cast("decimal(38,0)")).alias("hash")).first()["hash"]
    return f"{int(total or 0) % MODULUS:016x}"


def schema_hash(spark: SparkSession, columns: list[str]) -> str:
    return spark.range(1).select(F.sha2(F.lit("|".join(columns)), 256).alias("h")).first()["h"]


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """All loads; none where nothing has been loaded yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def latest_loads(spark: SparkSession, base: str) -> DataFrame:
    """The last good load of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("loaded_at"), F.desc("version"))
    good = manifest(spark, base).where("status = 'ready'")
    return good.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _record(spark: SparkSession, base: str, state: Row, **values) -> None:
    row = {"source": state["source"], "bytes": state["bytes"], "modified": state["modified"]} | values
    fields = [f.split()[0] for f in MANIFEST.split(", ")][:-1]
    frame = spark.createDataFrame([tuple(row.get(f) for f in fields)], MANIFEST.rsplit(", ", 1)[0])
    frame.withColumn("loaded_at", F.current_timestamp()).write.mode("append").parquet(f"{base}/manifest")


def load(spark: SparkSession, path: str, base: str, force: bool = False) -> Load:
    """Load the CSV file at ``path`` into the tables under ``base``, unless it is unchanged."""
    state = file_state(spark, path)
    last = latest_loads(spark, base).where(F.col("source") == state["source"]).first()
    if last and not force:
        seen = Load(last["version"], True, last["n_raw"], last["n_rejected"], last["n_accepted"])
        if (last["bytes"], last["modified"]) == (state["bytes"], state["modified"]):
            return seen
        if last["bytes"] == state["bytes"] and last["content_hash"] == content_hash(spark, path):
            _record(spark, base, state, **{k: last[k] for k in _HELD}, status="ready")  # only the time stamp is new
            return seen
    version = uuid.uuid4().hex
    try:
        at = f"{base}/versions/{version}"
        counted = {t: Observation() for t in TABLES}
        watched = lambda rows, t: rows.observe(counted[t], F.count(F.lit(1)).alias("n")).write
        watched(ingest.read_csv(spark, path), "raw").parquet(f"{at}/raw")
        rows = ingest.validated(spark.read.parquet(f"{at}/raw"))
        watched(ingest.rejected(rows), "rejects").parquet(f"{at}/rejects")
        watched(ingest.accepted(rows), "deliveries").partitionBy("season_id").parquet(f"{at}/deliveries")
    except Exception as e:
        _record(spark, base, state, status="failed", message=str(e)[:500])
        raise
    n = [counted[t].get["n"] for t in TABLES]
    hashes = {"content_hash": content_hash(spark, path), "schema_hash": schema_hash(spark, list(ingest.COLUMNS))}
    _record(spark, base, state, status="ready", version=version, loaded=version, n_raw=n[0], n_rejected=n[1], n_accepted=n[2], **hashes)
    return Load(version, False, *n)


def _deliveries(spark: SparkSession, base: str, load: Row) -> DataFrame:
    """The deliveries of one row of the manifest."""

    def of(version: str) -> DataFrame:
        return spark.read.schema(DELIVERIES).parquet(f"{base}/versions/{version}/deliveries")

    if load["seasons"] is None:
        return of(load["version"])
    held: dict[str, list[int]] = {}
    for season, version in sorted(load["seasons"].items()):
        held.setdefault(version, []).append(season)
    empty = spark.createDataFrame([], DELIVERIES)
    return reduce(DataFrame.unionByName, (of(v).where(F.col("season_id").isin(seasons)) for v, seasons in held.items()), empty)


def table(spark: SparkSession, base: str, name: str, source: str | None = None) -> DataFrame:
    """The rows that hold of ``name`` (one of TABLES): of the last good load of each source, or of one."""
    loads = latest_loads(spark, base)
    loads = (loads if source is None else loads.where(F.col("source").endswith(source))).collect()  # a row for each source file
    if not loads:
        raise ValueError(f"nothing has been loaded into {base}")
    if name != "deliveries":
        return spark.read.parquet(*(f"{base}/versions/{x['loaded'] or x['version']}/{name}" for x in loads))
    plain = [f"{base}/versions/{x['version']}/deliveries" for x in loads if x["seasons"] is None]
    merged = [_deliveries(spark, base, x) for x in loads if x["seasons"] is not None]
    return reduce(DataFrame.unionByName, ([spark.read.schema(DELIVERIES).parquet(*plain)] if plain else []) + merged)


def merge(spark: SparkSession, base: str, source: str, rows: DataFrame, replace: bool = False) -> Load:
    """Merge ``rows`` (columns of the deliveries; those that lack are null) by IDENTITY into the deliveries of ``source``.

    A ball that is there already stays, or with ``replace`` gives way. Of rows with one identity the first counts, or with ``replace`` the last,
    by source_row_number, nulls first, and then by all columns. Rows without a whole identity are not merged. Only seasons in which a ball
    is new, or replaced, are written.
    """
    found = latest_loads(spark, base).where(F.col("source").endswith(source)).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} sources of {base} end in {source}")
    last, version = found[0], uuid.uuid4().hex
    try:
        kinds = {f.split()[0]: f.split()[1] for f in DELIVERIES.split(", ")}
        new = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
        new = new.where(reduce(lambda a, c: a & F.col(c).isNotNull(), ingest.IDENTITY, F.lit(True))).withColumn("timeline_key", timeline_key())
        pick = F.max if replace else F.min
        order = [F.coalesce("source_row_number", F.lit(-1)).alias("_at"), *(F.col(c) for c in kinds if c not in ingest.IDENTITY)]
        new = new.groupBy(*ingest.IDENTITY).agg(pick(F.struct(*order)).alias("x")).select(*ingest.IDENTITY, "x.*").select(*kinds)
        held = _deliveries(spark, base, last)
        if not replace:
            new = new.join(held.select(*ingest.IDENTITY), list(ingest.IDENTITY), "left_anti")
        new = _written(spark, new, f"{base}/versions/{version}/merged")
        touched = sorted(r[0] for r in new.select("season_id").distinct().collect())  # seasons
        stays = held.where(F.col("season_id").isin(touched))
        stays = stays.join(new.select(*ingest.IDENTITY), list(ingest.IDENTITY), "left_anti") if replace else stays
        count = Observation()
        before = held.where(F.col("season_id").isin(touched)).count()
        after = stays.unionByName(new).observe(count, F.count(F.lit(1)).alias("n"))
        after.write.partitionBy("season_id").parquet(f"{base}/versions/{version}/deliveries")
        seasons = last["seasons"] or {r[0]: last["version"] for r in held.select("season_id").distinct().collect()}
        n = last["n_accepted"] - before + count.get["n"]
        values = {k: last[k] for k in _HELD} | {"version": version, "seasons": seasons | dict.fromkeys(touched, version), "n_accepted": n}
    except Exception as e:
        _record(spark, base, last, status="failed", message=str(e)[:500])
        raise
    _record(spark, base, last, **values, status="ready")
    return Load(version, False, last["n_raw"], last["n_rejected"], n)


def _written(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def status(spark: SparkSession, base: str) -> DataFrame:
    """Of each source: its last load's status and rows, and the version that readers see."""
    w = Window.partitionBy("source").orderBy(F.desc("loaded_at"))
    last = manifest(spark, base).withColumn("k", F.row_number().over(w)).where("k = 1").select("source", F.col("status").alias("last_status"), "message")
    held = latest_loads(spark, base).select("source", "version", "n_raw", "n_rejected", "n_accepted")
    return last.join(held, "source", "left")
