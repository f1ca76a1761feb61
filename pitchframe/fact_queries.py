"""Queries on recorded facts, named balls, ledgers and evidence; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import more_queries as Q
from . import registry as R
from .functions.expr import COUNTS, LABELS, PROBS
from .operators import evaluate as E
from .operators import facts as X
from .registry import BALL, KEYS, SEASON, STATE_CTE, query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- facts: customers as records of players, orders as records of teams' seasons ------------------------------------------
def player_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    status = F.element_at(F.array(F.lit("verified"), F.lit(" Verified"), F.lit("provisional"), F.lit(None)), (F.col("c_custkey") % 4 + 1).cast("int"))
    role = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.lower("c_mktsegment"))
    return X.player_facts(people.select(F.col("c_name").alias("player"), F.col("n_name").alias("nationality"), role.alias("role"), status.alias("status")), "nationality", "role")


R.QUERIES["q_player_facts"] = player_facts
R.ORACLES["q_player_facts"] = """
WITH k AS (
  SELECT c_name AS player, n_name AS nationality, CASE WHEN c_acctbal < 0 THEN ' ' ELSE lower(c_mktsegment) END AS role, c_custkey % 4 < 2 AS verified
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT player, attribute, CASE WHEN verified AND trim(value) <> '' THEN value END AS value, coalesce((verified AND trim(value) <> '')::INT, 0) AS told
FROM (SELECT player, verified, 'nationality' AS attribute, nationality AS value FROM k UNION ALL SELECT player, verified, 'role', role FROM k)
"""


def team_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Team"), (F.col("o_custkey") % 8).cast("string")).alias("team"), F.year("o_orderdate").alias("season_id"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", " VERIFIED ").when(F.col("o_orderstatus") == "O", "provisional").alias("status"),
        F.date_trunc("month", F.col("o_orderdate")).alias("retrieved_at"), F.concat(F.lit("Captain"), F.col("o_custkey").cast("string")).alias("captain"), F.col("o_orderpriority").alias("coach"),
    )
    return X.team_season(rows, "captain", "coach")


R.QUERIES["q_team_season_info"] = team_seasons
R.ORACLES["q_team_season_info"] = """
SELECT team, season_id, captain, coach FROM (
  SELECT 'Team' || (o_custkey % 8) AS team, year(o_orderdate)::INT AS season_id, 'Captain' || o_custkey AS captain, o_orderpriority AS coach, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey % 8, year(o_orderdate) ORDER BY date_trunc('month', o_orderdate) DESC, o_orderkey DESC) AS k FROM orders)
WHERE k = 1 AND o_orderstatus = 'F'
"""

# --- named balls and ledgers ----------------------------------------------------------------------------------------------
_NAMED = {"season_id": SEASON, "match_id": SEASON * 100 + 20, "innings": 1, "over_number": 3, "ball_number": 2}
_THREE = ", ".join(f"{m}_{p}" for m in E.MODELS for p in PROBS)
_TRACE = Q._trace(SEASON - 1, SEASON)
query(
    "q_predict_ball", lambda b: X.predict_ball(b, **_NAMED),
    f"{_TRACE} SELECT {BALL}, actual, legal_phase, level, sample, reliability, {_THREE} FROM trace WHERE {' AND '.join(f'{k} = {v}' for k, v in _NAMED.items())}",
)

_TOP = R._top([f"hierarchical_{p}" for p in PROBS])
_CAME = ", ".join(f"count(*) FILTER (actual = '{x}') AS {c}" for x, c in zip(LABELS, COUNTS, strict=True))
_IN = ", ".join(f"count(*) FILTER (legal_phase = '{p}') AS in_{p}" for p in ("powerplay", "middle", "death"))
query(
    "q_replay_report", lambda b: X.replay_report(E.trace(b, SEASON - 1, SEASON)),
    f"{_TRACE}, topped AS (SELECT *, {_TOP} AS top FROM trace) SELECT *, round(RATIO(correct, predictions, 1.0), 6) AS accuracy FROM (SELECT {KEYS}, count(*) AS predictions, count(*) FILTER (top = actual) AS correct, count(*) FILTER (top <> actual) AS incorrect, {_CAME}, {_IN} FROM topped GROUP BY ALL)",
)
query(
    "q_ledger_accuracy", lambda b: X.ledger_accuracy(E.trace(b, SEASON - 1, SEASON), X.same_again(b)),
    f"""{_TRACE}, topped AS (SELECT *, {_TOP} AS top FROM trace), calls AS (SELECT {BALL}, lag(label) OVER (PARTITION BY {KEYS} ORDER BY over_number, ball_number, source_row_number) AS call FROM balls)
SELECT *, RATIO(user_correct, revealed, 1.0) AS user_accuracy, RATIO(model_correct, revealed, 1.0) AS model_accuracy FROM (
  SELECT {KEYS}, count(*) AS revealed, count(call) AS called, count(*) FILTER (call = actual) AS user_correct, count(*) FILTER (top = actual) AS model_correct FROM topped LEFT JOIN calls USING ({BALL}) GROUP BY ALL)""",
)

# --- trust, time and evidence ---------------------------------------------------------------------------------------------
_GATES = R.ORACLES["q_trust_gate"]
query("q_verified_coverage", lambda b: X.verified_coverage(Q._covered(b), Q.T.trust_gate(Q._covered(b), Q._reconciled(b))))
R.ORACLES["q_verified_coverage"] = f"""
SELECT season_id, (gate NOT LIKE 'BLOCKED%')::INT AS trusted, CASE WHEN gate LIKE 'BLOCKED%' THEN lower(gate) ELSE 'ok' END AS reason FROM ({_GATES})
"""
query(
    "q_timeline", X.timeline,
    f"{STATE_CTE} SELECT {BALL}, printf('%04d-%08d-%02d-%02d-%02d', season_id, match_id, innings, over_number, ball_number) AS timeline_key, ((legal_before + legal_ball) // 6) || '.' || ((legal_before + legal_ball) % 6) AS overs FROM stated",
)
query(
    "q_matchup_evidence", X.matchup_evidence,
    """SELECT *, floor(runs * 100.0::DOUBLE / nullif(balls, 0) * 100 + 0.5) / 100 AS strike_rate, floor(runs * 1.0::DOUBLE / nullif(outs, 0) * 100 + 0.5) / 100 AS average,
  CASE WHEN balls >= 120 THEN 'high' WHEN balls >= 40 THEN 'medium' WHEN balls >= 12 THEN 'low' ELSE 'small' END AS evidence FROM (
  SELECT batter, bowler, ISUM(1 - is_wide_ball) AS balls, ISUM(batter_runs) AS runs, count(*) FILTER (is_wicket = 1 AND player_out = batter) AS outs, ISUM(total_runs - bye_runs - leg_bye_runs) AS conceded FROM balls GROUP BY ALL)""",
)
