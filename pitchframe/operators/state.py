"""The state of play strictly before each ball, from windows over the ball's own innings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import LABELS, conceded, outcome, phase_legal, ratio, total

INNINGS = ("season_id", "match_id", "innings")
BALL = ("over_number", "ball_number", "source_row_number")
BEFORE = (Window.unboundedPreceding, -1)

#: What ``with_state``, ``with_recent``, the sums of PLAY and ``with_rates`` add, and the phase.
STATE = (
    "score_before", "wickets_before", "legal_before", "legal_phase", *(f"recent_{x.replace('+', 'p')}" for x in LABELS), "recent", "window_runs",
    "window_legal", "window_wickets", "striker_runs", "striker_balls", "spell_conceded", "spell_balls", "partnership_runs", "partnership_balls",
    "target", "window_rate", "striker_rate", "spell_economy", "partnership_rate", "required_rate", "current_rate", "gap",
)

#: By a key in an innings: sums over the key's earlier balls there, and the columns (``with_played``) that they add up.
PLAY = {
    "batter": {"striker_runs": "batter_runs", "striker_balls": "faced"},
    "bowler": {"spell_conceded": "conceded", "spell_balls": "legal_ball"},
    "wickets_before": {"partnership_runs": "total_runs", "partnership_balls": "legal_ball"},
}
#: What the state of play is made of.
PLAYED = ("score_before", "wickets_before", "legal_before", "total_runs", "is_wicket", "legal_ball", "batter", "bowler", "batter_runs", "faced", "conceded")


def _innings(*more: str):
    return Window.partitionBy(*INNINGS, *more).orderBy(*BALL)


def _sum(column, window, name: str):
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(column).over(window), F.lit(0)).cast("bigint").alias(name)


def with_state(balls: DataFrame) -> DataFrame:
    """Score, wickets and legal balls before each ball: three sums of one window."""
    before = _innings().rowsBetween(*BEFORE)
    return balls.select(
        "*", _sum("total_runs", before, "score_before"), _sum("is_wicket", before, "wickets_before"),
        _sum("legal_ball", before, "legal_before"),
    )


def innings_progression(balls: DataFrame) -> DataFrame:
    now = _innings().rowsBetween(Window.unboundedPreceding, 0)
    return balls.select(
        *INNINGS, *BALL, "total_runs", _sum("total_runs", now, "score"), _sum("is_wicket", now, "wickets")
    )


def score_at_delivery(balls: DataFrame) -> DataFrame:
    """Score, wickets, legal balls and run rate including each ball."""
    now = _innings().rowsBetween(Window.unboundedPreceding, 0)
    rows = balls.select(
        *INNINGS, *BALL, _sum("total_runs", now, "score"), _sum("is_wicket", now, "wickets"), _sum("legal_ball", now, "legal_balls")
    )
    return rows.withColumn("run_rate", ratio("score", "legal_balls", 6))


def pre_ball_state(balls: DataFrame) -> DataFrame:
    return with_state(balls).select(
        *INNINGS, *BALL, "score_before", "wickets_before", "legal_before", phase_legal().alias("phase"), outcome().alias("outcome")
    )


def striker_state(balls: DataFrame) -> DataFrame:
    """The striker's runs, balls and boundaries in this innings before each ball."""
    w = _innings("batter").rowsBetween(*BEFORE)
    four = F.when(F.col("batter_runs").isin(4, 6), 1).otherwise(0)
    rows = balls.select(
        *INNINGS, *BALL, "batter", _sum("batter_runs", w, "striker_runs"), _sum(1 - F.col("is_wide_ball"), w, "striker_balls"),
        _sum(four, w, "striker_boundaries"),
    )
    return rows.withColumn("striker_rate", ratio("striker_runs", "striker_balls", 100))


def bowler_state(balls: DataFrame) -> DataFrame:
    """The bowler's spell in this innings before each ball; all wickets count."""
    w = _innings("bowler").rowsBetween(*BEFORE)
    four = F.when(F.col("batter_runs").isin(4, 6), 1).otherwise(0)
    rows = balls.select(
        *INNINGS, *BALL, "bowler", _sum(conceded(), w, "spell_conceded"), _sum("legal_ball", w, "spell_balls"),
        _sum("is_wicket", w, "spell_wickets"), _sum(four, w, "spell_boundaries"),
    )
    return rows.withColumn("spell_economy", ratio("spell_conceded", "spell_balls", 6))


def recent_outcomes(balls: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` outcomes before each ball, oldest first, as counts and as text."""
    w = _innings().rowsBetween(-n, -1)
    rows = balls.withColumn("label", outcome())
    counts = [
        F.coalesce(F.sum(F.when(F.col("label") == x, 1).otherwise(0)).over(w), F.lit(0)).cast("bigint").alias(f"recent_{x.replace('+', 'p')}")
        for x in LABELS
    ]
    return rows.select(*INNINGS, *BALL, *counts, F.array_join(F.collect_list("label").over(w), " ").alias("recent"))


def recent_window(balls: DataFrame, n: int = 12) -> DataFrame:
    """Runs, wickets, legal balls, boundaries and dots of the last ``n`` deliveries before each ball."""
    w = _innings().rowsBetween(-n, -1)
    four = F.when(F.col("batter_runs").isin(4, 6), 1).otherwise(0)
    dot = F.when(F.col("total_runs") == 0, 1).otherwise(0)
    rows = balls.select(
        *INNINGS, *BALL, _sum("total_runs", w, "window_runs"), _sum("is_wicket", w, "window_wickets"),
        _sum("legal_ball", w, "window_legal"), _sum(four, w, "window_boundaries"), _sum(dot, w, "window_dots"),
    )
    return rows.withColumn("window_rate", ratio("window_runs", "window_legal", 6))


def partnership(balls: DataFrame) -> DataFrame:
    """Runs and legal balls since the last wicket before each ball."""
    rows = with_state(balls)
    w = _innings("wickets_before").rowsBetween(*BEFORE)
    rows = rows.select(
        *INNINGS, *BALL, "wickets_before", _sum("total_runs", w, "partnership_runs"), _sum("legal_ball", w, "partnership_balls")
    )
    return rows.withColumn("partnership_rate", ratio("partnership_runs", "partnership_balls", 100))


def chase(balls: DataFrame) -> DataFrame:
    """Second innings: target, required and current rate, and the gap between them, before each ball (120 balls)."""
    first = balls.where("innings = 1").groupBy("season_id", "match_id").agg((F.sum("total_runs") + 1).cast("bigint").alias("target"))
    rows = with_state(balls).where("innings = 2").join(first, ["season_id", "match_id"], "left")
    left = F.greatest(F.lit(120) - F.col("legal_before"), F.lit(0))
    rows = rows.withColumn("balls_remaining", left).withColumn("wickets_remaining", F.greatest(10 - F.col("wickets_before"), F.lit(0)))
    need = F.greatest(F.col("target") - F.col("score_before"), F.lit(0))
    required = F.when(F.col("target").isNotNull() & (left > 0), need * 6.0 / left)
    rows = rows.withColumn("required_rate", required).withColumn("current_rate", ratio("score_before", "legal_before", 6))
    gap = F.col("required_rate") - F.col("current_rate")
    pressure = F.when(gap >= 2, "high").when(gap <= -1.5, "low").otherwise("balanced")
    return rows.select(
        *INNINGS, *BALL, "target", "balls_remaining", "wickets_remaining", "required_rate", "current_rate",
        gap.alias("gap"), pressure.alias("pressure"),
    )


def with_played(rows: DataFrame) -> DataFrame:
    """``rows`` with the balls faced and the runs conceded of each ball."""
    return rows.withColumns({"faced": 1 - F.col("is_wide_ball"), "conceded": conceded()})


def with_recent(rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` (PLAYED, and a label) with the recent outcomes and the last twelve balls before each ball of an innings, and of ``more`` inside it."""
    last6, last12 = _innings(*more).rowsBetween(-6, -1), _innings(*more).rowsBetween(-12, -1)
    label = F.col("label")
    return rows.select("*", *(_sum(F.when(label == x, 1).otherwise(0), last6, f"recent_{x.replace('+', 'p')}") for x in LABELS),
                       F.array_join(F.collect_list(label).over(last6), " ").alias("recent"), _sum("total_runs", last12, "window_runs"),
                       _sum("legal_ball", last12, "window_legal"), _sum("is_wicket", last12, "window_wickets"))


def with_rates(rows: DataFrame, balls: DataFrame) -> DataFrame:
    """``rows`` with the chase of the first innings of ``balls``, and the rates of the state of play."""
    first = balls.where("innings = 1").groupBy("season_id", "match_id").agg((F.sum("total_runs") + 1).cast("bigint").alias("target"))
    rows = rows.join(F.broadcast(first), ["season_id", "match_id"], "left")  # a row for each match
    left = F.greatest(F.lit(120) - F.col("legal_before"), F.lit(0))
    required = F.when((F.col("innings") == 2) & F.col("target").isNotNull() & (left > 0), F.greatest(F.col("target") - F.col("score_before"), F.lit(0)) * 6.0 / left)
    rates = {
        "window_rate": ratio("window_runs", "window_legal", 6), "striker_rate": ratio("striker_runs", "striker_balls", 100),
        "spell_economy": ratio("spell_conceded", "spell_balls", 6), "partnership_rate": ratio("partnership_runs", "partnership_balls", 100),
        "required_rate": required, "current_rate": ratio("score_before", "legal_before", 6),
    }
    return rows.withColumns(rates).withColumn("gap", F.col("required_rate") - F.col("current_rate"))


def replay_start_points(balls: DataFrame) -> DataFrame:
    """The first ball of each over with the state before it."""
    w = Window.partitionBy(*INNINGS, "over_number").orderBy("ball_number", "source_row_number")
    rows = with_state(balls).withColumn("first", F.row_number().over(w)).where("first = 1")
    return rows.select(*INNINGS, "over_number", "ball_number", "score_before", "wickets_before", "legal_before")


def season_match_number(balls: DataFrame) -> DataFrame:
    matches = balls.select("season_id", "match_id").distinct()
    w = Window.partitionBy("season_id").orderBy("match_id")
    return matches.withColumn("match_number", F.dense_rank().over(w).cast("bigint"))


def chronology(balls: DataFrame) -> DataFrame:
    """By season: first and last match, and whether the season overlaps the next one's matches."""
    seasons = balls.groupBy("season_id").agg(F.min("match_id").alias("first_match"), F.max("match_id").alias("last_match"))
    following = F.lead("first_match").over(Window.orderBy("season_id"))  # a row for each season
    return seasons.select("season_id", "first_match", "last_match", F.coalesce(following <= F.col("last_match"), F.lit(False)).cast("int").alias("overlaps"))
