"""Records of CSV files with quotes, read in splits: quoted commas, doubled quotes and line breaks inside quotes.

Whether a line begins inside quotes depends on all lines in front of it, so no split can tell alone. What a line does is one of
four things: it ends as it begins, the other way round, always outside, or always inside quotes. A task goes through its split once and
states each line's begin and number for both cases; a split's own effect is one of the four again. One window over the splits (a row
each) then says how each really begins and how many records lie in front. Records of one line, which nearly all are, are parsed where they
stand; only lines of longer ones are gathered.

Defined results: a quote opens a field at its first character only and is a plain character elsewhere; behind a closing quote the rest of the
field is plain; records end with a line feed, with or without a carriage return; blank lines are no records; a record
of over ``LONGEST`` characters that spans lines (a quote that is never closed) is named by its first line, with a problem, as is one
that cannot be read; a byte order mark is left out; an empty file has no records. Every file has a header, the same for all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 1 << 20
MOST_SPLITS = 1_000_000  #: rows of some 100 bytes that are still sent to all tasks; more are joined by a shuffle
MARKED = "file string, start long, at long, value string, before0 boolean, before1 boolean, after0 boolean, after1 boolean, k0 long, k1 long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of the line, which begins inside them or at the first character of a field."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at = line.find(",", at + 1)
            if at < 0:
                return False
            at += 1
        if line[at : at + 1] == '"':
            at += 1
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            at += 2
        inside = True


def fields_of(record: str) -> list[str] | None:
    """The record's fields; None if it cannot be read."""
    if '"' not in record and "\r" not in record:
        return record.split(",")
    import csv

    csv.field_size_limit(1 << 30)
    try:
        return next(csv.reader([record]), [""])
    except csv.Error:
        return None


def _marked(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    split, states, counts = None, (False, True), [0, 0]
    for batch in batches:
        values = batch.column("value").to_pylist()
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        n = len(values)
        before, after, k = np.zeros((2, n), bool), np.zeros((2, n), bool), np.zeros((2, n), np.int64)
        for i, (key, line) in enumerate(zip(keys, values, strict=True)):
            if key != split:
                split, states, counts = key, (False, True), [0, 0]
                if key[1] == 0 and line.startswith("﻿"):
                    values[i] = line = line[1:]
            quoted = '"' in line
            blank = not line or line == "\r"
            before[0, i], before[1, i] = states
            if quoted:
                states = tuple(ends_inside(line, s) for s in states)
            after[0, i], after[1, i] = states
            if not blank:
                counts[0] += not before[0, i]
                counts[1] += not before[1, i]
            k[0, i], k[1, i] = counts
        own = [batch.column("file"), batch.column("start"), batch.column("at"), pa.array(values, pa.string())]
        columns = [*own, *map(pa.array, before), *map(pa.array, after), *map(pa.array, k)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MARKED.split(", ")])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start of its split, at (a number that grows inside a split) and value of each line."""
    rows = spark.read.option("lineSep", "\n").text(path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select(*place, F.monotonically_increasing_id().alias("at"), "value")


def splits(marked: DataFrame) -> DataFrame:
    """file, start, inside (whether the split begins inside quotes), ahead (records of the file that begin in front of it) and others
    (records but the headers of files in front of this one)."""
    last = F.max_by(F.struct("after0", "after1", "k0", "k1"), "at").alias("l")
    effect = marked.groupBy("file", "start").agg(last).select("file", "start", "l.*")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("after0") & ~F.col("after1"), 1).otherwise(0)
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").cast("int").alias("is"), F.col("turned")))
    effect = effect.withColumn("turned", F.sum(turns).over(Window.partitionBy("file").orderBy("start")))
    known, turned = F.last(fixed, ignorenulls=True).over(earlier), F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    state = F.coalesce(F.pmod(known["is"] + turned - known["turned"], F.lit(2)), F.pmod(turned, F.lit(2))) == 1
    effect = effect.withColumn("inside", state).withColumn("own", F.when(F.col("inside"), F.col("k1")).otherwise(F.col("k0")))
    effect = effect.select("file", "start", "inside", "own", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("ahead"))
    files = effect.groupBy("file").agg(F.sum("own").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(before), F.lit(0)).alias("others"))
    return effect.drop("own").join(files, "file")


def records(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """k (which record of its file, from 1), row, record and problem of each record of ``lines``. Rows count the records from 2 but
    for headers, which are 1, over all files in the order of their paths."""
    marked = found.mapInArrow(_marked, MARKED)
    effects, at_most = splits(marked), found.rdd.getNumPartitions() + len(found.inputFiles())
    placed = marked.join(F.broadcast(effects) if at_most <= MOST_SPLITS else effects, ["file", "start"])
    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    rows = placed.select(
        "file", "start", "at", "value", pick("before0", "before1").alias("before"), pick("after0", "after1").alias("after"), (pick("k0", "k1") + F.col("ahead")).alias("k"), "others"
    ).withColumn("row", F.when(F.col("k") > 1, F.col("k") + F.col("others")).otherwise(1))
    rows = rows.where(F.col("before") | ~F.col("value").isin("", "\r"))
    whole = ~F.col("before") & ~F.col("after")
    single = rows.where(whole).select("k", "row", F.regexp_replace("value", "\r$", "").alias("record"), F.lit(None).cast("string").alias("problem"))
    parts = rows.where(~whole)
    first = F.min(F.struct("start", "at", "value"))["value"]
    sizes = parts.groupBy("file", "k", "row").agg(F.sum(F.length("value") + 1).alias("size"), F.max_by("after", F.struct("start", "at")).alias("open"), first.alias("first"))
    bad = F.col("open") | (F.col("size") > longest)
    broken = sizes.where(bad).select("k", "row", F.col("first").alias("record"), F.lit("unclosed_quote").alias("problem"))
    kept = parts.join(sizes.where(~bad).select("file", "k"), ["file", "k"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "value"))), lambda x: x["value"]), "\n")
    several = kept.groupBy("file", "k", "row").agg(F.regexp_replace(text, "\r$", "").alias("record"))
    several = several.select("k", "row", "record", F.lit(None).cast("string").alias("problem"))
    return single.unionByName(several).unionByName(broken)


def header(spark: SparkSession, path: str) -> list[str]:
    """The header's fields, of the first record of each file; an error if files differ."""
    found = records(lines(spark, path).where(F.col("start") == 0)).where("k = 1").select("record").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"files of {path} have different headers")
    return fields_of(found[0]["record"]) or [] if found else []


def parsed(found: DataFrame, names: list[str], wanted: tuple[str, ...]) -> DataFrame:
    """row, problem and the ``wanted`` columns of ``records`` that are no headers, as text; a record of too few or too many fields has a problem."""
    at = [names.index(c) for c in wanted]

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, problems = [], batch.column("problem").to_pylist()
            for i, record in enumerate(batch.column("record").to_pylist()):
                fields = fields_of(record) if problems[i] is None else []
                if fields is None:
                    problems[i], fields = "unreadable_record", []
                elif len(fields) != len(names) and problems[i] is None:
                    problems[i] = f"too_{'few' if len(fields) < len(names) else 'many'}_fields:{len(fields)}"
                rows.append([fields[k] if k < len(fields) else None for k in at])
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(problems, pa.string()), *columns], ["row", "problem", *wanted])

    return found.where("k > 1").mapInArrow(parse, ", ".join(["row long", "problem string", *(f"`{c}` string" for c in wanted)]))
