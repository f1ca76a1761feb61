"""Column factories shared by all operators on deliveries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The outcome labels, and the wickets that are not the bowler's.
LABELS = ("0", "1", "2", "3+", "4", "6", "wicket")
NOT_THE_BOWLERS = ("run out", "retired hurt", "retired out", "obstructing the field")

#: Names of the seven count columns of a histogram, in label order.
COUNTS = tuple(f"n_{x.replace('+', 'p')}" for x in LABELS)
PROBS = tuple(f"p_{x.replace('+', 'p')}" for x in LABELS)


def outcome() -> Column:
    """A delivery's label: a wicket first, then its total runs."""
    runs = F.col("total_runs")
    label = F.when(F.col("is_wicket") == 1, "wicket")
    for n in (0, 1, 2, 4, 6):
        label = label.when(runs == n, str(n))
    return label.otherwise("3+")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def total(condition: Column, name: str) -> Column:
    return F.sum(flag(condition)).cast("bigint").alias(name)


def summed(column: str | Column, name: str) -> Column:
    return F.sum(column).cast("bigint").alias(name)


def phase_legal(legal_before: str | Column = "legal_before") -> Column:
    """Phase by legal balls bowled before."""
    balls = F.col(legal_before) if isinstance(legal_before, str) else legal_before
    return F.when(balls < 36, "powerplay").when(balls < 90, "middle").otherwise("death")


def phase_over(over: str = "over_number") -> Column:
    """Phase by the over's number; differs from ``phase_legal`` where overs had extra balls."""
    return F.when(F.col(over) < 6, "powerplay").when(F.col(over) < 15, "middle").otherwise("death")


def credited_wicket() -> Column:
    """Whether the wicket is the bowler's."""
    return (F.col("is_wicket") == 1) & ~F.lower(F.coalesce("wicket_kind", F.lit(""))).isin(*NOT_THE_BOWLERS)


def conceded() -> Column:
    return F.col("total_runs") - F.col("bye_runs") - F.col("leg_bye_runs")


def ratio(a: str | Column, b: str | Column, by: float = 1.0, empty: float | None = 0.0) -> Column:
    """by * a / b, ``empty`` where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    value = F.try_divide(a.cast("double") * by, b.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def smoothed(counts: list[Column], alpha: float = 1.0) -> list[Column]:
    """Laplace-smoothed shares of the seven counts."""
    n = sum(counts[1:], counts[0])
    return [(c + alpha) / (n + alpha * len(LABELS)) for c in counts]


def top_label(values: list[Column]) -> Column:
    """The label of the largest value; the first in label order where equal."""
    most = F.greatest(*values)
    label = F.when(values[0] == most, LABELS[0])
    for name, value in zip(LABELS[1:-1], values[1:-1], strict=True):
        label = label.when(value == most, name)
    return label.otherwise(LABELS[-1])


def tier(value: str | Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that ``value`` reaches."""
    value = F.col(value) if isinstance(value, str) else value
    name = F.when(value >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        name = name.when(value >= least, label)
    return name.otherwise(rest)


# Thresholds of the evidence labels.
EVIDENCE_TIER = ([(120, "high"), (40, "medium"), (12, "low")], "small")
RELIABILITY = ([(180, "high"), (60, "medium"), (20, "low")], "very_low")
FEATURE_STRENGTH = ([(1200, "high"), (250, "medium"), (40, "low")], "very_low")
VENUE_TIER = ([(2500, "high"), (600, "medium"), (120, "low")], "very_low")
HIERARCHY_TIER = ([(100, "high"), (30, "medium")], "low")
SAMPLE_BUCKET = ([(1000, "1000+"), (300, "300-999"), (100, "100-299"), (30, "30-99")], "0-29")


def timeline_key() -> Column:
    return F.format_string("%04d-%08d-%02d-%02d-%02d", "season_id", "match_id", "innings", "over_number", "ball_number")


def overs_notation(balls: str | Column) -> Column:
    balls = F.col(balls) if isinstance(balls, str) else balls
    return F.concat(F.floor(balls / 6).cast("string"), F.lit("."), (balls % 6).cast("string"))
