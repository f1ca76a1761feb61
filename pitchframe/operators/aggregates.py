"""Aggregates of deliveries: careers, matchups, seasons, dimensions. Each takes the deliveries and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import COUNTS, LABELS, conceded, credited_wicket, flag, outcome, phase_legal, ratio, summed, total
from .state import INNINGS, with_state


def histogram(balls: DataFrame, *keys: str) -> DataFrame:
    """The seven outcome counts by ``keys``; zero where a label does not occur."""
    label = outcome()
    return balls.groupBy(*keys).agg(*(total(label == x, n) for x, n in zip(LABELS, COUNTS, strict=True)))


def distinct(*columns: str) -> Column:
    return F.countDistinct(F.struct(*columns))


def batting(balls: DataFrame, *keys: str) -> DataFrame:
    """Runs, balls faced (no wides), fours, sixes, dots, outs of the batter, and the rates of them."""
    faced = F.col("is_wide_ball") == 0
    sums = balls.groupBy(*keys).agg(
        summed("batter_runs", "runs"), total(faced, "balls"), total(F.col("batter_runs") == 4, "fours"),
        total(F.col("batter_runs") == 6, "sixes"), total(faced & (F.col("total_runs") == 0), "dots"),
        total(F.col("player_out") == F.col("batter"), "dismissals"), distinct(*INNINGS).alias("innings_batted"),
    )
    return sums.withColumn("strike_rate", ratio("runs", "balls", 100)).withColumn("dot_pct", ratio("dots", "balls", 100))


def bowling(balls: DataFrame, *keys: str) -> DataFrame:
    """Runs conceded (no byes), legal balls, the bowler's wickets, dots, and the rates of them."""
    sums = balls.groupBy(*keys).agg(
        summed(conceded(), "runs_conceded"), summed("legal_ball", "legal_balls"), total(credited_wicket(), "wickets"),
        total(F.col("total_runs") == 0, "dots"), distinct(*INNINGS).alias("innings_bowled"),
    )
    return sums.withColumn("economy", ratio("runs_conceded", "legal_balls", 6)).withColumn(
        "dot_pct", ratio("dots", "legal_balls", 100)
    )


def dataset_summary(balls: DataFrame) -> DataFrame:
    return balls.agg(
        F.countDistinct("season_id").alias("seasons"), distinct("season_id", "match_id").alias("matches"),
        distinct(*INNINGS).alias("innings"), F.count("*").alias("deliveries"), summed("is_wicket", "wickets"),
    )


def matches_per_season(balls: DataFrame) -> DataFrame:
    return balls.groupBy("season_id").agg(F.countDistinct("match_id").alias("matches"))


def runs_by_over(balls: DataFrame) -> DataFrame:
    return balls.groupBy(*INNINGS, "over_number").agg(summed("total_runs", "runs"), summed("is_wicket", "wickets"))


def innings_summary(balls: DataFrame) -> DataFrame:
    return balls.groupBy(*INNINGS, "team_batting", "team_bowling").agg(
        F.count("*").alias("deliveries"), summed("legal_ball", "legal_balls"), summed("total_runs", "runs"),
        summed("is_wicket", "wickets"),
    )


def matchup(balls: DataFrame, *keys: str) -> DataFrame:
    """Deliveries, batter's runs and all wickets by ``keys``; a null type is a group."""
    return balls.groupBy(*keys).agg(
        F.count("*").alias("deliveries"), summed("batter_runs", "runs"), summed("is_wicket", "wickets")
    )


def phase_outcome(balls: DataFrame) -> DataFrame:
    rows = with_state(balls).select(phase_legal().alias("phase"), outcome().alias("outcome"))
    return rows.groupBy("phase", "outcome").agg(F.count("*").alias("n"))


def outcome_totals(balls: DataFrame) -> DataFrame:
    return balls.groupBy(outcome().alias("outcome")).agg(F.count("*").alias("n"))


def outcome_share(balls: DataFrame) -> DataFrame:
    """Each batter's outcomes as shares of the batter's balls."""
    counts = histogram(balls, "batter")
    n = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("outcome"), F.col(c).alias("n")) for x, c in zip(LABELS, COUNTS, strict=True))))
    return counts.select("batter", n.alias("total"), rows.alias("r")).select(
        "batter", "r.outcome", "r.n", ratio("r.n", "total").alias("share")
    )


def dim_teams(balls: DataFrame) -> DataFrame:
    return balls.select(F.explode(F.array("team_batting", "team_bowling")).alias("team")).distinct()


ROLES = ("batter", "bowler", "non_striker", "player_out", "fielders_involved")


def dim_players(balls: DataFrame) -> DataFrame:
    """All names in any of the five roles, from one scan."""
    return balls.select(F.explode(F.array(*ROLES)).alias("player")).where("player IS NOT NULL").distinct()


def dim_matches(balls: DataFrame) -> DataFrame:
    return balls.groupBy("match_id").agg(F.min("season_id").alias("season_id"), F.max("is_super_over").alias("has_super_over"))


def player_overview(balls: DataFrame) -> DataFrame:
    """Batting and bowling of every player in one row, with the role that follows from the balls."""
    bat, bowl = batting(balls, "batter"), bowling(balls, "bowler")
    both = bat.select(F.col("batter").alias("player"), "runs", "balls", "dismissals", "innings_batted").join(
        bowl.select(F.col("bowler").alias("player"), "runs_conceded", "legal_balls", "wickets", "innings_bowled"),
        "player", "full",
    )
    numbers = [c for c in both.columns if c != "player"]
    both = both.select("player", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))
    bats, bowls = F.col("balls") > 0, F.col("legal_balls") > 0
    role = F.when(bats & bowls, "all_rounder").when(bats, "batter").when(bowls, "bowler").otherwise("unknown")
    return both.withColumn("role", role)


def player_matches(balls: DataFrame) -> DataFrame:
    """Matches in which a player appears in any of the five roles."""
    rows = balls.select("season_id", "match_id", F.explode(F.array(*ROLES)).alias("player")).where("player IS NOT NULL")
    return rows.groupBy("player").agg(distinct("season_id", "match_id").alias("matches"))


def phase_split(balls: DataFrame, player: str, f) -> DataFrame:
    return f(with_state(balls).withColumn("phase", phase_legal()), player, "phase")


def player_activity(balls: DataFrame) -> DataFrame:
    """Balls in which a player bats or bowls."""
    rows = balls.select(F.explode(F.array("batter", "bowler")).alias("player"))
    return rows.groupBy("player").agg(F.count("*").alias("activity"))


def player_matchups(balls: DataFrame, player: str, other: str, most: int, least: int = 4) -> DataFrame:
    """Each player's ``most`` commonest opponents; those with fewer than ``least`` balls are dropped afterwards."""
    from pyspark.sql import Window

    rows = matchup(balls, player, other)
    order = Window.partitionBy(player).orderBy(F.desc("deliveries"), other)
    top = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return top.where(F.col("deliveries") >= least)


def player_search(balls: DataFrame, query: str, limit: int) -> DataFrame:
    """Players whose name has ``query`` in it, ignoring case and spaces."""
    key = F.regexp_replace(F.lower("player"), r"\s+", "")
    found = dim_players(balls).where(key.contains("".join(query.lower().split())))
    return found.orderBy("player").limit(max(1, min(limit, 200)))


def top_performers(balls: DataFrame, season: int, limit: int) -> DataFrame:
    """The season's leading run scorers and wicket takers."""
    own = balls.where(F.col("season_id") == season)
    by_wickets = flag((F.col("is_wicket") == 1) & ~F.coalesce("wicket_kind", F.lit("")).isin(
        "run out", "retired hurt", "retired out", "obstructing the field"))
    sides = []
    for kind, player, value in (("runs", "batter", F.col("batter_runs")), ("wickets", "bowler", by_wickets)):
        sums = own.groupBy(F.col(player).alias("player")).agg(summed(value, "value"))
        top = sums.orderBy(F.desc("value"), "player").limit(max(1, min(limit, 25)))
        sides.append(top.select(F.lit(kind).alias("kind"), "player", "value"))
    return sides[0].unionByName(sides[1])


def season_overview(balls: DataFrame) -> DataFrame:
    legal = F.col("legal_ball") == 1
    sums = balls.groupBy("season_id").agg(
        F.countDistinct("match_id").alias("matches"), distinct(*INNINGS).alias("innings"), summed("batter_runs", "runs"),
        summed("legal_ball", "legal_balls"), total(F.col("batter_runs") == 4, "fours"), total(F.col("batter_runs") == 6, "sixes"),
        total(legal & (F.col("total_runs") == 0), "dots"), total(credited_wicket(), "wickets"),
    )
    return sums.withColumn("dot_pct", ratio("dots", "legal_balls", 100))


def leaderboards(balls: DataFrame, season: int, limit: int = 10, least_balls: int = 120) -> dict[str, DataFrame]:
    """The season's seven boards: (player, value), rates only with ``least_balls`` balls or more."""
    own = balls.where(F.col("season_id") == season)
    bat, bowl = batting(own, "batter"), bowling(own, "bowler")
    innings = own.groupBy("batter", *INNINGS).agg(summed("batter_runs", "score"))
    best = innings.groupBy("batter").agg(F.max("score").alias("score"))

    def board(rows: DataFrame, player: str, value: str, rising: bool = False) -> DataFrame:
        order = F.asc_nulls_last("value") if rising else F.desc_nulls_last("value")
        got = rows.select(F.col(player).alias("player"), F.col(value).alias("value"))
        return got.orderBy(order, "player").limit(max(1, min(limit, 25)))

    return {
        "runs": board(bat, "batter", "runs"),
        "wickets": board(bowl, "bowler", "wickets"),
        "sixes": board(bat, "batter", "sixes"),
        "fours": board(bat, "batter", "fours"),
        "highest_score": board(best, "batter", "score"),
        "strike_rate": board(bat.where(F.col("balls") >= least_balls), "batter", "strike_rate"),
        "economy": board(bowl.where(F.col("legal_balls") >= least_balls), "bowler", "economy", rising=True),
    }


def season_quality(balls: DataFrame) -> DataFrame:
    legal = F.col("legal_ball") == 1
    return balls.groupBy("season_id").agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("deliveries"),
        total(F.col("batter_runs") == 4, "fours"), total(F.col("batter_runs") == 6, "sixes"), summed("is_wicket", "wickets"),
        total(legal & (F.col("total_runs") == 0), "dots"), total(legal & (F.col("batter_runs") == 0), "batter_dots"),
    )


def duplicate_identities(rows: DataFrame, group: str, identity: list[str]) -> DataFrame:
    """By ``group``: rows beyond the first of each identity."""
    counts = rows.groupBy(group, *identity).agg(F.count("*").alias("n")).where("n > 1")
    return counts.groupBy(group).agg(summed(F.col("n") - 1, "duplicates"))


def malformed(balls: DataFrame) -> DataFrame:
    """Rows by season with blank or missing names, or runs that do not add up."""
    blank = F.lit(False)
    for c in ("batter", "bowler", "team_batting", "team_bowling"):
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    wrong = blank | (F.col("batter_runs") + F.col("extras") != F.col("total_runs"))
    return balls.groupBy("season_id").agg(total(wrong, "malformed"), F.count("*").alias("deliveries"))


def dot_gap(balls: DataFrame) -> DataFrame:
    """Legal balls without a run off the bat that do score: by kinds of extra, total and super over."""
    kinds = F.concat_ws("+", *(F.when(F.col(c) == 1, n) for c, n in (("is_bye", "bye"), ("is_leg_bye", "leg_bye"))))
    rows = balls.where("legal_ball = 1 AND batter_runs = 0 AND total_runs > 0")
    return rows.groupBy(kinds.alias("kinds"), "total_runs", "is_super_over").agg(F.count("*").alias("n"))


def median_delivery(balls: DataFrame, season: int, order: tuple[str, ...]) -> DataFrame:
    """The middle row of a season in chronological order."""
    own = balls.where(F.col("season_id") == season)
    innings, within = list(order[:3]), order[3:]
    sizes = own.groupBy(*innings).agg(F.count("*").alias("n"))  # a row for each innings: the middle one is found among these
    running = Window.orderBy(*innings).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0))).withColumn("middle", F.floor(F.sum("n").over(every) / 2))
    chosen = sizes.where("middle >= start AND middle < start + n").select(*innings, (F.col("middle") - F.col("start") + 1).alias("place"))
    rows = own.join(F.broadcast(chosen), innings)  # one innings
    place = F.row_number().over(Window.partitionBy(*innings).orderBy(*within))
    return rows.withColumn("k", place).where("k = place").select(*order, "batter", "bowler", "total_runs")
