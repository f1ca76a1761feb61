"""Matches, standings, scorecards, squads and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, summed, total
from .aggregates import innings_summary
from .state import INNINGS

FULL_INNINGS = 120


def net_run_rate(balls: DataFrame) -> DataFrame:
    """By season and team: runs and balls for and against, and the net run rate. An all-out innings counts 120 balls.

    Only innings 1 and 2 face each other; each is joined to the other one of its match.
    """
    innings = innings_summary(balls).where("innings IN (1, 2)").withColumn(
        "faced", F.when(F.col("wickets") >= 10, FULL_INNINGS).otherwise(F.col("legal_balls"))
    )
    side = innings.groupBy("season_id", "match_id", "innings").agg(
        F.max("team_batting").alias("team"), summed("runs", "runs"), summed("faced", "faced")
    )
    other = side.select("season_id", "match_id", (3 - F.col("innings")).alias("innings"), F.col("runs").alias("against"), F.col("faced").alias("bowled"))
    rows = side.join(other, list(INNINGS))
    sums = rows.groupBy("season_id", "team").agg(*(summed(c, c) for c in ("runs", "faced", "against", "bowled")))
    return sums.withColumn("nrr", ratio("runs", "faced", 6) - ratio("against", "bowled", 6))


def points_table(balls: DataFrame, meta: DataFrame) -> DataFrame:
    """Two points a win, one each without a winner; ordered by points, net run rate and team."""
    sides = meta.select("season_id", "winner", F.explode(F.array("team_a", "team_b")).alias("team")).where("team IS NOT NULL")
    won, none = F.col("winner") == F.col("team"), F.col("winner").isNull()
    table = sides.groupBy("season_id", "team").agg(
        F.count("*").alias("played"), total(won, "won"), total(~won, "lost"), total(none, "no_result"),
        summed(F.when(won, 2).when(none, 1).otherwise(0), "points"),
    )
    rates = net_run_rate(balls).select("season_id", "team", "nrr")
    return table.join(rates, ["season_id", "team"], "left").withColumn("nrr", F.coalesce("nrr", F.lit(0.0))).orderBy("season_id", F.desc("points"), F.desc("nrr"), "team")


def scorecard_batting(balls: DataFrame) -> DataFrame:
    faced = F.col("is_wide_ball") == 0
    rows = balls.groupBy(*INNINGS, "batter").agg(
        summed("batter_runs", "runs"), total(faced, "balls"), total(F.col("batter_runs") == 4, "fours"),
        total(F.col("batter_runs") == 6, "sixes"), F.max(F.coalesce((F.col("player_out") == F.col("batter")).cast("int"), F.lit(0))).alias("out"),
    )
    status = F.when(F.col("out") == 1, "out").otherwise("not out")
    return rows.withColumn("strike_rate", ratio("runs", "balls", 100)).withColumn("status", status).drop("out")


def scorecard_bowling(balls: DataFrame) -> DataFrame:
    """All wickets count here."""
    given = F.col("total_runs") - F.col("bye_runs") - F.col("leg_bye_runs")
    rows = balls.groupBy(*INNINGS, "bowler").agg(summed("legal_ball", "legal_balls"), summed(given, "runs"), summed("is_wicket", "wickets"))
    return rows.withColumn("economy", ratio("runs", "legal_balls", 6))


def match_top_performers(balls: DataFrame) -> DataFrame:
    """The batter with most runs and the bowler with most wickets of each match; the first name where equal."""
    keys = ["season_id", "match_id"]
    bat = balls.groupBy(*keys, "batter").agg(summed("batter_runs", "runs"))
    bowl = balls.groupBy(*keys, "bowler").agg(summed("is_wicket", "wickets"))

    def first(rows: DataFrame, name: str, value: str, to: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(value), name)
        return rows.withColumn("position", F.row_number().over(w)).where("position = 1").select(*keys, F.col(name).alias(to), value)

    return first(bat, "batter", "runs", "top_batter").join(first(bowl, "bowler", "wickets", "top_bowler"), keys)


def innings_swing(balls: DataFrame) -> DataFrame:
    rows = balls.groupBy("season_id", "match_id").agg(
        *(F.sum(F.when(F.col("innings") == n, F.col("total_runs"))).cast("bigint").alias(f"innings_{n}") for n in (1, 2))
    )
    return rows.withColumn("swing", F.col("innings_2") - F.col("innings_1"))


def team_squad(balls: DataFrame) -> DataFrame:
    """By season and team: players with the balls they bat or bowl for it, and the matches they take part in."""
    bat = balls.select("season_id", "match_id", F.col("team_batting").alias("team"), F.col("batter").alias("player"), F.lit(1).alias("touch"))
    bowl = balls.select("season_id", "match_id", F.col("team_bowling").alias("team"), F.col("bowler").alias("player"), F.lit(1).alias("touch"))
    beside = balls.select("season_id", "match_id", F.col("team_batting").alias("team"), F.col("non_striker").alias("player"), F.lit(0).alias("touch"))
    every = bat.unionByName(bowl).unionByName(beside).where("player IS NOT NULL")
    return every.groupBy("season_id", "team", "player").agg(summed("touch", "touches"), F.countDistinct("match_id").alias("matches")).where("touches > 0")


def list_seasons(balls: DataFrame) -> DataFrame:
    return balls.groupBy("season_id").agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("deliveries"), F.countDistinct("team_batting").alias("teams")
    )


def list_matches(balls: DataFrame, meta: DataFrame) -> DataFrame:
    """Matches with number in the season, teams, deliveries (each once), venue and winner."""
    sums = balls.groupBy("season_id", "match_id").agg(F.count("*").alias("deliveries"), F.countDistinct("innings").alias("innings"))
    w = Window.partitionBy("season_id").orderBy("match_id")
    rows = sums.withColumn("match_number", F.dense_rank().over(w).cast("bigint")).join(meta, ["season_id", "match_id"], "left")
    return rows.select("season_id", "match_id", "match_number", "deliveries", "innings", "team_a", "team_b", "venue", "winner")


def match_detail(balls: DataFrame, meta: DataFrame) -> DataFrame:
    scores = innings_swing(balls)
    return meta.join(scores, ["season_id", "match_id"], "left")


def match_search(meta: DataFrame, text: str, team: str | None = None) -> DataFrame:
    """Matches whose venue, teams or winner have ``text`` in them, of one team if given."""
    key = F.lower(F.concat_ws(" ", "venue", "team_a", "team_b", "winner"))
    found = meta.where(key.contains(text.lower()))
    if team is not None:
        found = found.where((F.col("team_a") == team) | (F.col("team_b") == team))
    return found.select("season_id", "match_id", "venue", "team_a", "team_b", "winner")


def fixtures(meta: DataFrame, today: str) -> DataFrame:
    """Every match with its status on the day ``today``."""
    status = F.when(F.coalesce("winner", F.lit("")) != "", "completed").when(F.col("match_date") >= F.lit(today).cast("date"), "upcoming")
    return meta.select("season_id", "match_id", "team_a", "team_b", status.otherwise("scheduled").alias("status"))


def results(meta: DataFrame) -> DataFrame:
    return meta.where("winner IS NOT NULL").select("season_id", "match_id", "winner", "match_type")


def season_compare(overview: DataFrame, a: int, b: int) -> DataFrame:
    """The overview's numbers in two seasons and how they moved, one row each."""
    numbers = ("matches", "runs", "legal_balls", "fours", "sixes", "dots", "wickets")
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in numbers)))
    long = overview.where(F.col("season_id").isin(a, b)).select("season_id", rows.alias("r"))
    sides = long.groupBy(F.col("r.metric").alias("metric")).agg(
        *(F.max(F.when(F.col("season_id") == s, F.col("r.value"))).alias(n) for s, n in ((a, "before"), (b, "after")))
    )
    return sides.withColumn("shift", F.col("after") - F.col("before"))
