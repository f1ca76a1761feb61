"""Running sums over all of time without a window that holds a whole key.

Order is cut into ranges: spans of ``SPAN`` matches of a season, and blocks of ``BLOCK`` matches in a span. Totals of each range and key are
summed exclusively over the blocks of a span, and spans over all of time; what a key has in front of a block is the sum of both. A window
holds the blocks of a span or the spans of a key, never the balls of a career. Match ids are numbers in the order of play in a season.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SPAN = 8, 4096
RANGE = ("season_id", "_span", "_block")


def ranged(rows: DataFrame) -> DataFrame:
    """``rows`` with the span and the block of their match; nulls, which come first, in ranges of their own."""
    return rows.withColumns({"_span": F.floor(F.col("match_id") / SPAN), "_block": F.floor(F.col("match_id") / BLOCK)})


def exclusive(totals: DataFrame, keys: list[str], values: list[str], order: tuple[str, ...] = ("_block",)) -> DataFrame:
    """``totals`` (keys, season_id, _span, order: one row each) with each of ``values`` summed over the key's rows in front, 0 for none."""
    inside = Window.partitionBy(*keys, "season_id", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("season_id", "_span").rowsBetween(Window.unboundedPreceding, -1)
    # Both branches read the same exchange, so that totals are made once; for that, both need all of its columns.
    totals = totals.repartition(*keys, "season_id", "_span")
    spans = totals.groupBy(*keys, "season_id", "_span").agg(*(F.sum(v).alias(v) for v in values), F.max(F.struct(*order)).alias("_last")).where("_last IS NOT NULL")
    place = [*keys, "season_id", "_span"]
    spans = spans.select(*(F.col(p).alias(f"at_{p}") for p in place), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"ahead_{v}") for v in values))
    same = reduce(lambda a, p: a & F.col(p).eqNullSafe(F.col(f"at_{p}")), place, F.lit(True))
    near = totals.select(*place, *order, *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in values))
    return near.join(spans, same).select(*place, *order, *((F.col(v) + F.col(f"ahead_{v}")).alias(v) for v in values))


def running(rows: DataFrame, keys: list[str], order: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``values`` summed over the key's rows in front, by ``order`` (which begins with season and match), 0 for none."""
    rows = ranged(rows.withColumns({f"_{n}": v for n, v in values.items()}))
    totals = rows.groupBy(*keys, *RANGE).agg(*(F.sum(f"_{n}").alias(n) for n in values))
    ahead = exclusive(totals, keys, list(values))
    inside = Window.partitionBy(*keys, *RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.select("*", *(F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(f"here_{n}") for n in values))
    place = [*keys, *RANGE]
    ahead = ahead.select(*(F.col(p).alias(f"at_{p}") for p in place), *(F.col(n).alias(f"from_{n}") for n in values))
    same = reduce(lambda a, p: a & F.col(p).eqNullSafe(F.col(f"at_{p}")), place, F.lit(True))
    kept = [c for c in rows.columns if c not in {*(f"_{n}" for n in values), "_span", "_block"}]
    return here.join(ahead, same).select(*kept, *((F.col(f"here_{n}") + F.col(f"from_{n}")).cast("bigint").alias(n) for n in values))
