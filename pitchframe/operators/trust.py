"""Coverage, reconciliation with a second source, and gates on trust. Tables have one row per season (and metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import total

METRICS = ("matches", "deliveries", "fours", "sixes", "wickets", "dots")
SAME = 1e-9


def coverage(local: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and local matches (season_id, match_id) by season: missing, unexpected and the status."""
    both = expected.distinct().withColumn("e", F.lit(1)).join(local.distinct().withColumn("l", F.lit(1)), ["season_id", "match_id"], "full")
    rows = both.groupBy("season_id").agg(
        total(F.col("e").isNotNull(), "expected"), total(F.col("l").isNotNull(), "local"),
        total(F.col("e").isNotNull() & F.col("l").isNull(), "missing"), total(F.col("e").isNull(), "unexpected"),
    )
    return rows.withColumn("coverage", F.when((F.col("missing") == 0) & (F.col("expected") > 0), "complete").otherwise("incomplete"))


def reconciliation(local: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per season and metric: both values, their difference and PASS, FAIL or UNAVAILABLE."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(["season_id"], list(METRICS), "metric", name).withColumn(name, F.col(name).cast("double"))

    rows = long(local, "local_value").join(long(reference, "reference_value"), ["season_id", "metric"], "full")
    delta = F.col("local_value") - F.col("reference_value")
    status = F.when(delta.isNull(), "UNAVAILABLE").when(F.abs(delta) <= SAME, "PASS").otherwise("FAIL")
    relative = F.when(F.col("reference_value") != 0, delta / F.col("reference_value"))
    return rows.select("season_id", "metric", "local_value", "reference_value", delta.alias("delta"), relative.alias("relative"), status.alias("status"))


def with_definitions(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Failures that another definition of the metric (season_id, metric, variant, value) explains get a note."""
    found = rows.where("status = 'FAIL'").join(variants, ["season_id", "metric"]).where(F.abs(F.col("value") - F.col("reference_value")) <= SAME)
    notes = found.groupBy("season_id", "metric").agg(F.min("variant").alias("note"))
    status = F.when(F.col("note").isNotNull(), "PASS_WITH_DEFINITION_NOTE").otherwise(F.col("status"))
    return rows.join(notes, ["season_id", "metric"], "left").withColumn("status", status)


def trust_gate(covered: DataFrame, reconciled: DataFrame) -> DataFrame:
    """By season: incomplete coverage, then failures, then notes, then unavailable metrics, else PASS."""
    counts = reconciled.groupBy("season_id").agg(
        total(F.col("status") == "FAIL", "failed"), total(F.col("status") == "PASS_WITH_DEFINITION_NOTE", "noted"),
        total(F.col("status") == "UNAVAILABLE", "unavailable"), total(F.col("status") == "PASS", "passed"),
    )
    rows = covered.select("season_id", "coverage").join(counts, "season_id", "full")
    # The names of the gates.
    gate = (
        F.when(F.coalesce("coverage", F.lit("incomplete")) != "complete", "BLOCKED_COVERAGE").when(F.col("failed") > 0, "BLOCKED_RECONCILIATION")
        .when(F.col("noted") > 0, "PASS_WITH_DEFINITION_NOTE").when(F.coalesce("passed", F.lit(0)) == 0, "UNAVAILABLE").otherwise("PASS")
    )
    return rows.select("season_id", gate.alias("gate"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("failed", "noted", "unavailable", "passed")))


def trust_dimensions(covered: DataFrame, reconciled: DataFrame, internal: DataFrame) -> DataFrame:
    """By season: source (coverage), external (reconciliation) and internal (malformed rows) trust, and the least of them."""
    external = reconciled.groupBy("season_id").agg(total(F.col("status") == "FAIL", "failed"))
    rows = covered.select("season_id", "coverage").join(external, "season_id", "left").join(internal.select("season_id", "malformed"), "season_id", "left")
    source = F.col("coverage") == "complete"
    outside, inside = F.coalesce("failed", F.lit(0)) == 0, F.coalesce("malformed", F.lit(0)) == 0
    name = lambda c: F.when(c, "verified").otherwise("provisional")
    return rows.select(
        "season_id", name(source).alias("source"), name(outside).alias("external"), name(inside).alias("internal"),
        name(source & outside & inside).alias("overall"),
    )


def cross_layer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two layers have the same metrics, by season."""
    joined = a.alias("a").join(b.alias("b"), "season_id", "full")
    same = F.lit(True)
    for m in METRICS:
        same = same & F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    return joined.select("season_id", same.cast("int").alias("equal"))


def allowed(gate: DataFrame, season: int) -> bool:
    """Whether statistics of the season may be told; seasons that no gate records may."""
    rows = gate.where(F.col("season_id") == season).select("gate").limit(1).collect()
    return not rows or not rows[0]["gate"].startswith("BLOCKED")
