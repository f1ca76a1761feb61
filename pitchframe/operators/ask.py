"""Answers about players, teams and seasons: each a declarative plan over the deliveries, for all entities at once.

A question about one player or team is a filter on the result; Catalyst moves it to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import conceded, ratio, summed, total
from .aggregates import batting, bowling

LEAST_BALLS = 24  #: of a rate that is ranked


def player_batting(balls: DataFrame, first: int, last: int, phase: str | None = None) -> DataFrame:
    """Batting numbers of every player in the seasons ``first`` to ``last``, in one phase (by overs) if given."""
    rows = balls.where(F.col("season_id").between(first, last))
    overs = {"powerplay": (0, 5), "middle": (6, 14), "death": (15, 10**6)}
    if phase is not None:
        rows = rows.where(F.col("over_number").between(*overs[phase]))
    return batting(rows, "batter").select("batter", "runs", "balls", "fours", "sixes", "dots", "dismissals", "strike_rate")


def player_bowling(balls: DataFrame, first: int, last: int) -> DataFrame:
    rows = balls.where(F.col("season_id").between(first, last))
    return bowling(rows, "bowler").select("bowler", "runs_conceded", "legal_balls", "wickets", "economy")


def bowler_vs_team(balls: DataFrame) -> DataFrame:
    """Each bowler against each batting team; all wickets count."""
    rows = balls.groupBy("bowler", "team_batting").agg(
        summed("legal_ball", "legal_balls"), summed(conceded(), "runs_conceded"), summed("is_wicket", "wickets")
    )
    return rows.withColumn("economy", ratio("runs_conceded", "legal_balls", 6))


def best_season(balls: DataFrame) -> DataFrame:
    """Each batter's season of most runs; the earlier one where equal."""
    rows = balls.groupBy("batter", "season_id").agg(summed("batter_runs", "runs"))
    w = Window.partitionBy("batter").orderBy(F.desc("runs"), "season_id")
    return rows.withColumn("position", F.row_number().over(w)).where("position = 1").drop("position")


def rank_batting(balls: DataFrame, season: int, limit: int, threshold: int = 0) -> DataFrame:
    """The top batters of a season by strike rate, with more than ``threshold`` runs off 24 balls or more."""
    rows = batting(balls.where(F.col("season_id") == season), "batter")
    kept = rows.where((F.col("balls") >= LEAST_BALLS) & (F.col("runs") > threshold))
    return kept.orderBy(F.desc("strike_rate"), "batter").limit(limit).select("batter", "runs", "balls", "strike_rate")


def rank_bowling(balls: DataFrame, season: int, limit: int) -> DataFrame:
    """The bowlers of a season with the lowest economy over 24 legal balls or more."""
    rows = bowling(balls.where(F.col("season_id") == season), "bowler").where(F.col("legal_balls") >= LEAST_BALLS)
    return rows.orderBy("economy", "bowler").limit(limit).select("bowler", "legal_balls", "wickets", "economy")


def compare(balls: DataFrame, a: str, b: str) -> DataFrame:
    """Two batters' numbers and which has more of each; the first one where equal."""
    sums = batting(balls.where(F.col("batter").isin(a, b)), "batter")
    numbers = ("runs", "balls", "fours", "sixes")
    long = sums.select("batter", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in numbers))).alias("r"))
    sides = long.groupBy(F.col("r.metric").alias("metric")).agg(
        *(F.coalesce(F.max(F.when(F.col("batter") == p, F.col("r.value"))), F.lit(0)).alias(n) for p, n in ((a, "first"), (b, "second")))
    )
    return sides.withColumn("winner", F.when(F.col("second") > F.col("first"), b).otherwise(a))


def recent_matches(balls: DataFrame, n: int = 3) -> DataFrame:
    """Each batter's last ``n`` matches, latest first."""
    rows = balls.groupBy("batter", "season_id", "match_id").agg(summed("batter_runs", "runs"), total(F.col("is_wide_ball") == 0, "balls"))
    w = Window.partitionBy("batter").orderBy(F.desc("season_id"), F.desc("match_id"))
    return rows.withColumn("back", F.row_number().over(w).cast("bigint")).where(F.col("back") <= n)


def vs_bowling_type(balls: DataFrame, *words: str) -> DataFrame:
    """Each batter against the types of bowling whose names have all ``words`` in them."""
    kind = F.lower("bowler_type")
    for w in words:
        balls = balls.where(kind.contains(w))
    return batting(balls, "batter").select("batter", "runs", "balls", "dismissals", "strike_rate")


def result_summary(meta: DataFrame) -> DataFrame:
    """Of each season the final, or else the latest match, with its winner."""
    final = (F.col("match_type") == "Final").cast("int")
    w = Window.partitionBy("season_id").orderBy(F.desc(final), F.desc("match_date"), F.desc("match_id"))
    rows = meta.withColumn("position", F.row_number().over(w)).where("position = 1")
    return rows.select("season_id", "match_id", "team_a", "team_b", F.coalesce("winner", F.lit("no result")).alias("winner"))


def replay_summary(predictions: DataFrame) -> DataFrame:
    """By innings of a replay with ``top`` and ``actual``: predictions, how many were right, and their share."""
    right = F.coalesce((F.col("top") == F.col("actual")).cast("int"), F.lit(0))
    rows = predictions.groupBy("season_id", "match_id", "innings").agg(F.count("*").alias("predictions"), summed(right, "correct"))
    return rows.withColumn("accuracy", ratio("correct", "predictions"))
