"""Deliveries and match records derived from order lines, for trying every operator on star-schema tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import flag

ORDER = (
    "d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
INNINGS = ("season_id", "match_id", "innings")
CHRONOLOGY = (*INNINGS, "over_number", "ball_number", "source_row_number")
BALLS = 100_000  #: of a task, about, where ``deliveries`` are cut
LINES = 250_000  #: of a task, about, that joins lines and orders
#: What a ball's columns are made of, and the bits that each takes in one number; players' numbers are small, a null one is 0 there.
FIELDS = {
    "supp": 7, "partner": 7, "bowl": 6, "kind": 3, "batter_runs": 3, "is_wide_ball": 1, "is_no_ball": 1, "is_leg_bye": 1, "is_bye": 1, "is_wicket": 1,
}
PLAYERS = {"supp": 40, "partner": 40, "bowl": 30}


class Dealt(NamedTuple):
    """Deliveries cut into ``tasks`` by innings, the same uncut, from which few columns are summed without an exchange by innings, and what
    innings are made of by orders (``sides``)."""

    balls: DataFrame
    plain: DataFrame
    sides: DataFrame
    tasks: int


def ball_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks cut deliveries have."""
    return max(spark.sparkContext.defaultParallelism, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // BALLS)


def _packed() -> Column:
    """FIELDS in one number, which an exchange carries in place of them."""
    out, at = F.lit(0).cast("bigint"), 0
    for name, bits in FIELDS.items():
        value = F.coalesce(F.col(name) + PLAYERS[name], F.lit(0)) if name in PLAYERS else F.col(name)
        out, at = out + F.shiftleft(value.cast("bigint"), at), at + bits
    return out


def _unpacked(packed: Column) -> dict[str, Column]:
    out, at = {}, 0
    for name, bits in FIELDS.items():
        value, at = F.shiftright(packed, at).bitwiseAND(F.lit((1 << bits) - 1)), at + bits
        out[name] = F.when(value != 0, value - PLAYERS[name]) if name in PLAYERS else value.cast("int")
    return out


def _dated(rows: DataFrame) -> DataFrame:
    day = F.dayofyear("d") - 1
    rows = rows.withColumns({"season_id": F.year("d"), "slot": F.floor(day / 10).cast("int"), "innings": F.when(day % 10 < 5, 1).otherwise(2)})
    return rows.withColumn("match_id", F.col("season_id") * 100 + F.col("slot"))


def _bowled(rows: DataFrame) -> DataFrame:
    """``rows`` with FIELDS, which go by a line alone."""
    q, tax = F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    rows = rows.withColumns({"q": q, "disc": F.round(F.col("l_discount") * 100).cast("int"), "tax": tax})
    q, tax = F.col("q"), F.col("tax")
    rows = rows.withColumns(
        {
            "supp": F.col("l_suppkey") % 40,
            "partner": (F.col("l_suppkey") + 7) % 40,
            "bowl": F.col("l_partkey") % 30,
            "kind": F.when(F.col("l_linenumber").between(1, 6), F.col("l_linenumber")).otherwise(0),
            "is_wide_ball": flag((tax == 8) & (q % 3 == 0)),
            "is_no_ball": flag((tax == 7) & (q % 5 == 0)),
            "is_leg_bye": flag((tax == 6) & (q % 7 == 0)),
            "is_bye": flag((tax == 5) & (q % 11 == 0)),
            "is_wicket": flag((F.col("disc") == 10) & (F.col("l_returnflag") != "N")),
        }
    )
    m = q % 20
    runs = F.when(m < 7, 0).when(m < 14, 1).when(m < 16, 2).when(m == 16, 3).when(m < 19, 4).otherwise(6)
    no_bat = (F.col("is_wide_ball") == 1) | (F.col("is_leg_bye") == 1) | (F.col("is_bye") == 1)
    return rows.withColumn("batter_runs", F.when(no_bat, 0).otherwise(runs))


def _extras() -> Column:
    return F.col("is_wide_ball") + F.col("is_no_ball") + F.col("is_leg_bye") + F.col("is_bye")


def _teams() -> tuple[Column, Column]:
    def team(other):
        return F.concat(F.lit("Team"), ((F.col("slot") + other * 3) % 8).cast("string"))

    return team(F.col("innings") - 1).alias("team_batting"), team(2 - F.col("innings")).alias("team_bowling")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: its match, innings, teams and day, and the runs of all of its balls. An order's lines are of one innings, so
    match records and targets add these up, and lines are summed before they are exchanged."""
    lines = _bowled(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    runs = lines.groupBy("l_orderkey").agg(F.sum(F.col("batter_runs") + _extras()).alias("total_runs"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").alias("d"))
    rows = _dated(runs.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    return rows.select("season_id", "match_id", "innings", *_teams(), "total_runs", F.col("d").cast("date").alias("played_on"))


def deliveries(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    """One row per ball. Matches are ten-day spans of a year, each half of a span an innings.

    Many lines meet their orders in as many tasks as they need at LINES a task: the join sorts both, and a session's number of shuffle
    partitions, which adaptive execution only lowers, would let a task's share grow with the tables. They are no more than these partitions
    or those that Spark writes without sorting in front of the exchange, where a task that scans lines would hold its whole split.

    ``cut``: innings are dealt to as many tasks as the lines need at BALLS a task, for plans that sort innings again and again: adaptive
    execution would give a task 64 MB of coded rows, which are millions of balls. Plans without balls' numbers need no exchange by innings.

    Where lines are dealt out to meet their orders, the exchange by innings carries a ball's place and one number that its columns are made of.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").alias("d"))
    cores, n = spark.sparkContext.defaultParallelism, lines.count()
    most = max(int(spark.conf.get(*x)) for x in (("spark.sql.shuffle.partitions", "200"), ("spark.shuffle.sort.bypassMergeThreshold", "200")))
    if dealt := (tasks := min(n // LINES, most)) > cores:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    rows = _bowled(_dated(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))))
    order = ORDER
    if dealt:
        # The lines of an order are in one task: their place among them stands for all columns behind the order's key.
        rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))
        order = ("d", "l_orderkey", "line")
        rows = rows.select(*INNINGS, *order, _packed().alias("packed"))
    if cut:
        rows = rows.repartition(max(cores, n // BALLS), *INNINGS)
    ball = Window.partitionBy(*INNINGS).orderBy(*order)  # by season too, so that a season's balls are read by themselves
    rows = rows.withColumn("rn", F.row_number().over(ball) - 1)
    if dealt:
        rows = rows.withColumns(_unpacked(F.col("packed"))).withColumn("slot", F.col("match_id") - F.col("season_id") * 100)
    supp, bowl = F.col("supp"), F.col("bowl")
    kinds = F.element_at(
        F.create_map(*map(F.lit, (1, "caught", 2, "bowled", 3, "lbw", 4, "run out", 5, "stumped", 6, "retired hurt"))),
        F.col("kind"),
    )
    wicket = F.col("is_wicket") == 1
    rows = rows.withColumns(
        {
            "batter": F.concat(F.lit("Bat"), supp.cast("string")),
            "non_striker": F.concat(F.lit("Bat"), F.col("partner").cast("string")),
            "bowler": F.concat(F.lit("Bowl"), bowl.cast("string")),
            "extras": _extras(),
            "wicket_kind": F.when(wicket, F.coalesce(kinds, F.lit("caught"))),
        }
    )
    rows = rows.withColumn("player_out", F.when(wicket, F.when(F.col("kind") == 4, F.col("non_striker")).otherwise(F.col("batter"))))
    types = F.element_at(
        F.create_map(*map(F.lit, (0, "right-arm pace", 1, "left-arm pace", 2, "right-arm spin", 3, "left-arm spin"))),
        (bowl % 5).cast("int"),
    )
    return rows.select(
        "season_id", "match_id", "innings",
        F.floor(F.col("rn") / 6).cast("int").alias("over_number"), (F.col("rn") % 6).cast("int").alias("ball_number"),
        (F.col("rn") + 2).cast("bigint").alias("source_row_number"),
        "batter", "bowler", "non_striker", *_teams(),
        "batter_runs", "extras", (F.col("batter_runs") + F.col("extras")).alias("total_runs"),
        F.when(supp % 3 == 0, "left-hand").otherwise("right-hand").alias("batsman_type"), types.alias("bowler_type"),
        "player_out", F.lit(None).cast("string").alias("fielders_involved"), "is_wicket", "is_wide_ball", "is_no_ball",
        "is_leg_bye", "is_bye", F.lit(0).alias("is_penalty"), F.col("is_wide_ball").alias("wide_ball_runs"),
        F.col("is_no_ball").alias("no_ball_runs"), F.col("is_leg_bye").alias("leg_bye_runs"),
        F.col("is_bye").alias("bye_runs"), F.lit(0).alias("penalty_runs"), "wicket_kind", F.lit(0).alias("is_super_over"),
        F.when((F.col("is_wide_ball") == 1) | (F.col("is_no_ball") == 1), 0).otherwise(1).alias("legal_ball"),
        F.col("d").cast("date").alias("played_on"),
    )


def match_meta(balls: DataFrame) -> DataFrame:
    """One row per match: venue, teams, winner by total runs (null on a tie or without a second innings), type, date."""
    first, second = (F.col("innings") == n for n in (1, 2))
    by_match = balls.groupBy("season_id", "match_id").agg(
        F.max(F.when(first, F.col("team_batting"))).alias("team_a"),
        F.max(F.when(first, F.col("team_bowling"))).alias("team_b"),
        F.sum(F.when(first, F.col("total_runs"))).alias("runs_a"),
        F.sum(F.when(second, F.col("total_runs"))).alias("runs_b"),
        F.min("played_on").alias("match_date"),
    )
    last = by_match.groupBy("season_id").agg(F.max("match_id").alias("last_match"))
    winner = F.when(F.col("runs_a") > F.col("runs_b"), F.col("team_a")).when(F.col("runs_b") > F.col("runs_a"), F.col("team_b"))
    return by_match.join(F.broadcast(last), "season_id").select(
        "season_id", "match_id", F.concat(F.lit("Venue"), (F.col("match_id") % 12).cast("string")).alias("venue"),
        "team_a", "team_b", winner.alias("winner"),
        F.when(F.col("match_id") == F.col("last_match"), "Final").otherwise("League").alias("match_type"), "match_date",
    )


#: The same deliveries and match records as DuckDB SQL, for the checks.
DELIVERIES_SQL = """
WITH base AS (
  SELECT l.*, o_orderdate AS d, year(o_orderdate)::INT AS season_id, ((dayofyear(o_orderdate) - 1) // 10)::INT AS slot,
    CASE WHEN (dayofyear(o_orderdate) - 1) % 10 < 5 THEN 1 ELSE 2 END AS innings, l_quantity::INT AS q,
    round(l_discount * 100)::INT AS disc, round(l_tax * 100)::INT AS tax
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
), numbered AS (
  SELECT *, season_id * 100 + slot AS match_id, row_number() OVER (PARTITION BY season_id * 100 + slot, innings
    ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
      l_returnflag, l_linestatus, l_shipdate) - 1 AS rn,
    (tax = 8 AND q % 3 = 0)::INT AS is_wide_ball, (tax = 7 AND q % 5 = 0)::INT AS is_no_ball,
    (tax = 6 AND q % 7 = 0)::INT AS is_leg_bye, (tax = 5 AND q % 11 = 0)::INT AS is_bye,
    (disc = 10 AND l_returnflag <> 'N')::INT AS is_wicket
  FROM base
), deliveries AS (
  SELECT season_id, match_id, innings, (rn // 6)::INT AS over_number, (rn % 6)::INT AS ball_number,
    (rn + 2)::BIGINT AS source_row_number, 'Bat' || (l_suppkey % 40) AS batter, 'Bowl' || (l_partkey % 30) AS bowler,
    'Bat' || ((l_suppkey + 7) % 40) AS non_striker, 'Team' || ((slot + (innings - 1) * 3) % 8) AS team_batting,
    'Team' || ((slot + (2 - innings) * 3) % 8) AS team_bowling,
    CASE WHEN is_wide_ball + is_leg_bye + is_bye > 0 THEN 0 WHEN q % 20 < 7 THEN 0 WHEN q % 20 < 14 THEN 1
      WHEN q % 20 < 16 THEN 2 WHEN q % 20 = 16 THEN 3 WHEN q % 20 < 19 THEN 4 ELSE 6 END AS batter_runs,
    is_wide_ball + is_no_ball + is_leg_bye + is_bye AS extras,
    CASE WHEN (l_suppkey % 40) % 3 = 0 THEN 'left-hand' ELSE 'right-hand' END AS batsman_type,
    CASE (l_partkey % 30) % 5 WHEN 0 THEN 'right-arm pace' WHEN 1 THEN 'left-arm pace' WHEN 2 THEN 'right-arm spin'
      WHEN 3 THEN 'left-arm spin' END AS bowler_type,
    CASE WHEN is_wicket = 1 THEN CASE WHEN l_linenumber = 4 THEN 'Bat' || ((l_suppkey + 7) % 40)
      ELSE 'Bat' || (l_suppkey % 40) END END AS player_out,
    is_wicket, is_wide_ball, is_no_ball, is_leg_bye, is_bye, is_leg_bye AS leg_bye_runs, is_bye AS bye_runs,
    CASE WHEN is_wicket = 1 THEN CASE l_linenumber WHEN 2 THEN 'bowled' WHEN 3 THEN 'lbw' WHEN 4 THEN 'run out'
      WHEN 5 THEN 'stumped' WHEN 6 THEN 'retired hurt' ELSE 'caught' END END AS wicket_kind,
    CASE WHEN is_wide_ball + is_no_ball > 0 THEN 0 ELSE 1 END AS legal_ball, 0 AS is_super_over, d::DATE AS played_on
  FROM numbered
), balls AS (
  SELECT *, batter_runs + extras AS total_runs,
    CASE WHEN is_wicket = 1 THEN 'wicket' WHEN batter_runs + extras IN (0, 1, 2, 4, 6)
      THEN (batter_runs + extras)::VARCHAR ELSE '3+' END AS label,
    (is_wicket = 1 AND lower(coalesce(wicket_kind, '')) NOT IN
      ('run out', 'retired hurt', 'retired out', 'obstructing the field'))::INT AS credited
  FROM deliveries
)"""

META_SQL = """, sides AS (
  SELECT season_id, match_id, max(team_batting) FILTER (innings = 1) AS team_a, max(team_bowling) FILTER (innings = 1) AS team_b,
    sum(total_runs) FILTER (innings = 1) AS runs_a, sum(total_runs) FILTER (innings = 2) AS runs_b, min(played_on) AS match_date
  FROM balls GROUP BY 1, 2
), meta AS (
  SELECT season_id, match_id, 'Venue' || (match_id % 12) AS venue, team_a, team_b,
    CASE WHEN runs_a > runs_b THEN team_a WHEN runs_b > runs_a THEN team_b END AS winner,
    CASE WHEN match_id = max(match_id) OVER (PARTITION BY season_id) THEN 'Final' ELSE 'League' END AS match_type, match_date
  FROM sides
)"""
