"""Queries that answer questions, and events in windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry as R
from .operators import ask as Q
from .operators import models as P
from .registry import BATTING, BATTING_RATES, BOWLING, BOWLING_RATES, KEYS, QUERIES, ORACLES, SEASON, _rated, query
from .sources import ingest
from .streaming import events

_BAT = lambda where: _rated(BATTING, BATTING_RATES, "batter", f"(SELECT * FROM balls WHERE {where})")
_BOWL = lambda where: _rated(BOWLING, BOWLING_RATES, "bowler", f"(SELECT * FROM balls WHERE {where})")
_ECONOMY = "RATIO(runs_conceded, legal_balls, 6) AS economy"

query("q_ask_player_batting", lambda b: Q.player_batting(b, 1996, 1999, "death"), f"SELECT batter, runs, balls, fours, sixes, dots, dismissals, strike_rate FROM ({_BAT('season_id BETWEEN 1996 AND 1999 AND over_number >= 15')})")
query("q_ask_player_bowling", lambda b: Q.player_bowling(b, 1996, 1999), f"SELECT bowler, runs_conceded, legal_balls, wickets, economy FROM ({_BOWL('season_id BETWEEN 1996 AND 1999')})")
query("q_ask_bowler_vs_team", Q.bowler_vs_team, f"SELECT *, {_ECONOMY} FROM (SELECT bowler, team_batting, ISUM(legal_ball) AS legal_balls, ISUM(total_runs - bye_runs - leg_bye_runs) AS runs_conceded, ISUM(is_wicket) AS wickets FROM balls GROUP BY ALL)")
query("q_ask_best_season", Q.best_season, "SELECT batter, season_id, runs FROM (SELECT batter, season_id, ISUM(batter_runs) AS runs FROM balls GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY batter ORDER BY runs DESC, season_id) = 1")
query("q_ask_rank_batting", lambda b: Q.rank_batting(b, SEASON, 10, 20), f"SELECT batter, runs, balls, strike_rate FROM ({_BAT(f'season_id = {SEASON}')}) WHERE balls >= 24 AND runs > 20 ORDER BY strike_rate DESC, batter LIMIT 10")
query("q_ask_rank_bowling", lambda b: Q.rank_bowling(b, SEASON, 10), f"SELECT bowler, legal_balls, wickets, economy FROM ({_BOWL(f'season_id = {SEASON}')}) WHERE legal_balls >= 24 ORDER BY economy, bowler LIMIT 10")
_SIDES = " UNION ALL ".join(f"SELECT '{n}' AS metric, coalesce(max({n}) FILTER (batter = 'Bat3'), 0) AS first, coalesce(max({n}) FILTER (batter = 'Bat5'), 0) AS second FROM o" for n in ("runs", "balls", "fours", "sixes"))
query("q_ask_compare", lambda b: Q.compare(b, "Bat3", "Bat5"), f", o AS ({_BAT('true')}) SELECT *, CASE WHEN second > first THEN 'Bat5' ELSE 'Bat3' END AS winner FROM ({_SIDES})")
query("q_ask_recent_matches", Q.recent_matches, "SELECT *, row_number() OVER (PARTITION BY batter ORDER BY season_id DESC, match_id DESC) AS back FROM (SELECT batter, season_id, match_id, ISUM(batter_runs) AS runs, count(*) FILTER (is_wide_ball = 0) AS balls FROM balls GROUP BY ALL) QUALIFY back <= 3")
query("q_ask_vs_bowling_type", lambda b: Q.vs_bowling_type(b, "left", "pace"), f"SELECT batter, runs, balls, dismissals, strike_rate FROM ({_BAT(chr(39).join(['lower(bowler_type) LIKE ', '%left%', ' AND lower(bowler_type) LIKE ', '%pace%', '']))})")
query("q_ask_result_summary", lambda b, m: Q.result_summary(m), "SELECT season_id, match_id, team_a, team_b, coalesce(winner, 'no result') AS winner FROM meta QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY (match_type = 'Final')::INT DESC, match_date DESC, match_id DESC) = 1", meta=True)
_HIER_SQL = ORACLES["q_model_hierarchical"]
query("q_top_outcome", lambda b, p: P.model_hierarchical(b, p).groupBy("top", "actual").agg(F.count("*").alias("n")), state=True, plain=True)
ORACLES["q_top_outcome"] = f"SELECT top, actual, count(*) AS n FROM ({_HIER_SQL}) GROUP BY ALL"
query("q_replay_summary", lambda b, p: Q.replay_summary(P.model_hierarchical(b, p)), state=True, plain=True)
ORACLES["q_replay_summary"] = R.exact(f"SELECT *, RATIO(correct, predictions, 1.0) AS accuracy FROM (SELECT {KEYS}, count(*) AS predictions, count(*) FILTER (top = actual) AS correct FROM ({_HIER_SQL}) GROUP BY ALL)")

QUERIES["q_events_hourly"] = lambda spark, sf_dir: events.hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))
ORACLES["q_events_hourly"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL"
QUERIES["q_ingest_duplicates"] = lambda spark, sf_dir: ingest.duplicates(
    spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"],
    ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"],
).select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")
ORACLES["q_ingest_duplicates"] = "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS occurrence FROM lineitem QUALIFY occurrence > 1"
