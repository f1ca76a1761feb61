"""Histories in which older balls count less: each ball weighs decay ** its age in balls, for any decay in (0, 1].

Balls are numbered in chronological order over the whole game. A key's balls inside a unit (an innings, or a part of one short
enough for the powers) take a running sum; totals of (key, unit) are carried on by a second running sum inside blocks of steps, and
totals of (key, block) to the few blocks after which they weigh under 1e-15. So no window holds a key's whole history,
no power overflows, and the result does not depend on where units and blocks are cut.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import COUNTS
from .evidence import CONTEXTS, _known
from .scan import exclusive, ranged
from .state import BALL, BEFORE, INNINGS

FORGOTTEN = 1e-15  #: a total that weighs less is dropped
REACH = 16  #: blocks that a total is carried over, about


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with step: how many balls were bowled before, over ranges of matches."""
    sizes = ranged(rows.groupBy(*INNINGS).agg(F.count("*").alias("first_step")))
    starts = exclusive(sizes, [], ["first_step"], ("match_id", "innings")).select(*INNINGS, "first_step")
    inside = Window.partitionBy(*INNINGS).orderBy(*BALL)
    return rows.join(starts, list(INNINGS)).withColumn("step", F.col("first_step") + F.row_number().over(inside) - 1)


def _power(decay: float, exponent: Column) -> Column:
    return F.lit(1.0) if decay == 1.0 else F.pow(F.lit(decay), exponent.cast("double"))


def _cuts(decay: float) -> tuple[int, int]:
    """Steps of a unit, whose powers stay below e ** 500, and of a block, after a few of which nothing is left."""
    if not 0.0 < decay <= 1.0:
        raise ValueError(f"a decay is above 0 and at most 1, not {decay}")
    rate = -math.log(decay)
    part = max(1, int(500 / rate)) if rate > 500 / 1e6 else 1_000_000
    return part, max(part, math.ceil(41 / (REACH * rate))) if rate > 1e-12 else 1 << 60


def _placed(rows: DataFrame, decay: float) -> DataFrame:
    part = _cuts(decay)[0]
    rows = rows.withColumn("unit", F.floor((F.col("step") - F.col("first_step")) / part))
    return rows.withColumn("unit_start", F.col("first_step") + F.col("unit") * part)


def unit_totals(rows: DataFrame, decay: float, *contexts: str) -> DataFrame:
    """The counts of each unit, brought to its first step, by everything that ``contexts`` are made of: a table that serves all of them."""
    keys = dict.fromkeys((*INNINGS, *(k for c in contexts for k in CONTEXTS[c])))
    inside = F.col("step") - F.col("unit_start")
    return _placed(rows, decay).groupBy(*keys, "unit", "unit_start").agg(*(F.sum(F.col(c) * _power(decay, -inside)).alias(c) for c in COUNTS))


def _earlier(totals: DataFrame, at: list[str], decay: float) -> DataFrame:
    """Of each (unit, key): earlier_* counts of the key's earlier units, brought to the unit's first step."""
    place, block, rate = [*INNINGS, "unit"], _cuts(decay)[1], -math.log(decay)
    totals = totals.groupBy(*place, *at, "unit_start").agg(*(F.sum(c).alias(c) for c in COUNTS))
    if block == 1 << 60:  # nothing decays: plain sums over ranges of matches
        found = exclusive(ranged(totals), at, list(COUNTS), ("match_id", "innings", "unit"))
        return found.select(*place, *at, *(F.col(c).alias(f"earlier_{c}") for c in COUNTS))
    totals = totals.withColumn("block", F.floor(F.col("unit_start") / block)).withColumn("ahead", F.col("unit_start") - F.col("block") * block)
    before = Window.partitionBy(*at, "block").orderBy("unit_start").rowsBetween(*BEFORE)
    near = [F.coalesce(F.sum(F.col(c) * _power(decay, -F.col("ahead"))).over(before), F.lit(0.0)) * _power(decay, F.col("ahead")) for c in COUNTS]
    found = totals.select(*place, *at, "block", "ahead", *(x.alias(f"earlier_{c}") for x, c in zip(near, COUNTS, strict=True)))
    reach = math.ceil(math.log(1 / FORGOTTEN * 1e3 * block) / (rate * block)) + 1
    sums = totals.groupBy(*at, "block").agg(*(F.sum(F.col(c) * _power(decay, block - F.col("ahead"))).alias(c) for c in COUNTS))
    on = sums.select(*at, "block", *COUNTS, F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("later"))
    on = on.select(*at, (F.col("block") + 1 + F.col("later")).alias("block"), *((F.col(c) * _power(decay, F.col("later") * block)).alias(c) for c in COUNTS))
    on = on.groupBy(*at, "block").agg(*(F.sum(c).alias(f"far_{c}") for c in COUNTS))
    far = [F.coalesce(F.col(f"far_{c}"), F.lit(0.0)) * _power(decay, F.col("ahead")) for c in COUNTS]
    both = [(F.col(f"earlier_{c}") + f).alias(f"earlier_{c}") for c, f in zip(COUNTS, far, strict=True)]
    return found.join(on, [*at, "block"], "left").select(*place, *at, *both)


def decayed(rows: DataFrame, context: str, decay: float, prefix: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """``rows`` (numbered) with the seven decayed counts of ``context`` before each ball, named ``prefix`` and the label.

    ``totals``: the ``unit_totals`` of the balls, so that a chain of histories does not read its own input twice a link.
    """
    keys, names = CONTEXTS[context], [f"{prefix or context}_{c}" for c in COUNTS]
    at, place = [f"key_{i}" for i in range(len(keys))], [*INNINGS, "unit"]
    # Keys are made non-null for the join; null keys then get zero counts.
    safe = lambda df: df.withColumns({a: F.coalesce(F.col(k).cast("string"), F.lit("")) for a, k in zip(at, keys, strict=True)})
    earlier = _earlier(safe(totals if totals is not None else unit_totals(rows, decay, context)), at, decay)
    inside = F.col("step") - F.col("unit_start")
    local = Window.partitionBy(*place, *at).orderBy(*BALL).rowsBetween(*BEFORE)
    sums = [F.coalesce(F.sum(F.col(c) * _power(decay, -inside)).over(local), F.lit(0.0)).alias(f"local_{c}") for c in COUNTS]
    here = safe(_placed(rows, decay)).select(*rows.columns, *at, "unit", inside.alias("inside"), *sums)
    value = [F.when(_known(keys), (F.col(f"local_{c}") + F.col(f"earlier_{c}")) * _power(decay, F.col("inside") - 1)).otherwise(0.0) for c in COUNTS]
    return here.join(earlier, [*place, *at]).select(*rows.columns, *(v.alias(n) for v, n in zip(value, names, strict=True)))


def decayed_histories(rows: DataFrame, decay: float, *contexts: str) -> DataFrame:
    """``rows`` with the decayed counts of each of ``contexts``."""
    rows = numbered(rows)
    totals = unit_totals(rows, decay, *contexts)
    return reduce(lambda df, context: decayed(df, context, decay, totals=totals), contexts, rows)
