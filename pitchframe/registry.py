"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import COUNTS, LABELS, PROBS, outcome
from .operators import aggregates as A
from .operators import evaluate as E
from .operators import evidence as H
from .operators import matches as M
from .operators import models as P
from .operators import state as S
from .operators import trust as T
from .sources import ingest
from .sources.adapter import DELIVERIES_SQL, META_SQL, Dealt, ball_tasks, deliveries, match_meta, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = "season_id, match_id, innings"
BALL = f"{KEYS}, over_number, ball_number, source_row_number"
CUTOFF, VALIDATION, SEASON = 1998, 1999, 2000


def exact(sql: str) -> str:
    """ISUM(x): a sum as BIGINT; RATIO(a, b, k): k * a / b, 0 where b is 0; R6(x): half up to six places."""
    forms = {
        "ISUM": lambda x: f"CAST(sum({x}) AS BIGINT)",
        "RATIO": lambda x: "CASE WHEN ({1}) = 0 THEN 0.0 ELSE CAST({0} AS DOUBLE) * {2} / ({1}) END".format(*x.split(",")),
        "R6": lambda x: f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)",
    }
    for name, form in forms.items():
        while (at := sql.find(f"{name}(")) >= 0:
            depth, end = 1, at + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + form(sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def query(name: str, f: Callable, sql: str | None = None, meta: bool = False, venue: bool = False, state: bool | None = None, plain: bool = False) -> None:
    """``f`` takes the deliveries (``Dealt``, with ``venue``, of the match record), and the match records too with ``meta``; ``sql`` follows
    the deliveries' CTEs. ``state``: whether it goes by the state of play, for which deliveries are cut; as its SQL does, if not said.
    ``plain``: ``f`` takes them uncut too."""
    state = STATE_CTE in (sql or "") if state is None else state

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        balls = deliveries(spark, sf_dir, cut=state)
        if venue:  # match records need no balls
            of = sides(spark, sf_dir)
            return f(Dealt(H.with_venue(balls, match_meta(of)), deliveries(spark, sf_dir), of, ball_tasks(spark, sf_dir)))
        if plain:
            return f(balls, deliveries(spark, sf_dir))
        return f(balls, match_meta(balls)) if meta else f(balls)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = exact(DELIVERIES_SQL + (META_SQL if meta else "") + "\n" + sql)


# --- aggregates ---------------------------------------------------------------------------------------------------------
COUNTS_SQL = ", ".join(f"count(*) FILTER (label = '{x}') AS {c}" for x, c in zip(LABELS, COUNTS, strict=True))
BATTING = f"""ISUM(batter_runs) AS runs, count(*) FILTER (is_wide_ball = 0) AS balls, count(*) FILTER (batter_runs = 4) AS fours,
  count(*) FILTER (batter_runs = 6) AS sixes, count(*) FILTER (is_wide_ball = 0 AND total_runs = 0) AS dots,
  count(*) FILTER (player_out = batter) AS dismissals, count(DISTINCT ({KEYS})) AS innings_batted"""
BATTING_RATES = "RATIO(runs, balls, 100) AS strike_rate, RATIO(dots, balls, 100) AS dot_pct"
BOWLING = f"""ISUM(total_runs - bye_runs - leg_bye_runs) AS runs_conceded, ISUM(legal_ball) AS legal_balls, ISUM(credited) AS wickets,
  count(*) FILTER (total_runs = 0) AS dots, count(DISTINCT ({KEYS})) AS innings_bowled"""
BOWLING_RATES = "RATIO(runs_conceded, legal_balls, 6) AS economy, RATIO(dots, legal_balls, 100) AS dot_pct"


def _rated(sums: str, rates: str, keys: str, source: str = "balls") -> str:
    return f"SELECT *, {rates} FROM (SELECT {keys}, {sums} FROM {source} GROUP BY {keys})"


STATE_CTE = f""", stated AS (
  SELECT *, coalesce(sum(total_runs) OVER w, 0)::BIGINT AS score_before, coalesce(sum(is_wicket) OVER w, 0)::BIGINT AS wickets_before,
    coalesce(sum(legal_ball) OVER w, 0)::BIGINT AS legal_before
  FROM balls WINDOW w AS (PARTITION BY {KEYS} ORDER BY over_number, ball_number, source_row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), phased AS (
  SELECT *, CASE WHEN legal_before < 36 THEN 'powerplay' WHEN legal_before < 90 THEN 'middle' ELSE 'death' END AS phase,
    CASE WHEN over_number < 6 THEN 'powerplay' WHEN over_number < 15 THEN 'middle' ELSE 'death' END AS over_phase
  FROM stated
)"""

query("q_dataset_summary", A.dataset_summary, f"SELECT count(DISTINCT season_id) AS seasons, count(DISTINCT (season_id, match_id)) AS matches, count(DISTINCT ({KEYS})) AS innings, count(*) AS deliveries, ISUM(is_wicket) AS wickets FROM balls")
query("q_matches_per_season", A.matches_per_season, "SELECT season_id, count(DISTINCT match_id) AS matches FROM balls GROUP BY 1")
query("q_batter_stats", lambda b: A.batting(b, "batter"), _rated(BATTING, BATTING_RATES, "batter"))
query("q_bowler_stats", lambda b: A.bowling(b, "bowler"), _rated(BOWLING, BOWLING_RATES, "bowler"))
query("q_runs_by_over", A.runs_by_over, f"SELECT {KEYS}, over_number, ISUM(total_runs) AS runs, ISUM(is_wicket) AS wickets FROM balls GROUP BY ALL")
query("q_outcome_distribution", lambda b: A.histogram(b, "season_id"), f"SELECT season_id, {COUNTS_SQL} FROM balls GROUP BY 1")
query("q_dim_teams", A.dim_teams, "SELECT team_batting AS team FROM balls UNION SELECT team_bowling FROM balls")
query("q_dim_players", A.dim_players, "SELECT batter AS player FROM balls UNION SELECT bowler FROM balls UNION SELECT non_striker FROM balls WHERE non_striker IS NOT NULL UNION SELECT player_out FROM balls WHERE player_out IS NOT NULL")
query("q_dim_matches", A.dim_matches, "SELECT match_id, min(season_id) AS season_id, max(is_super_over) AS has_super_over FROM balls GROUP BY 1")
query("q_innings_summary", A.innings_summary, f"SELECT {KEYS}, team_batting, team_bowling, count(*) AS deliveries, ISUM(legal_ball) AS legal_balls, ISUM(total_runs) AS runs, ISUM(is_wicket) AS wickets FROM balls GROUP BY ALL")
for _name, _keys in (("batter_bowler", ("batter", "bowler")), ("batter_bowler_type", ("batter", "bowler_type")), ("bowler_batter_type", ("bowler", "batsman_type"))):
    query(f"q_matchup_{_name}", lambda b, k=_keys: A.matchup(b, *k), f"SELECT {', '.join(_keys)}, count(*) AS deliveries, ISUM(batter_runs) AS runs, ISUM(is_wicket) AS wickets FROM balls GROUP BY ALL")
query("q_phase_outcome", A.phase_outcome, f"{STATE_CTE} SELECT phase, label AS outcome, count(*) AS n FROM phased GROUP BY ALL")
query("q_outcome_totals", A.outcome_totals, "SELECT label AS outcome, count(*) AS n FROM balls GROUP BY 1")
query("q_outcome_share", A.outcome_share, ", labels AS (SELECT unnest(['0', '1', '2', '3+', '4', '6', 'wicket']) AS outcome), totals AS (SELECT batter, count(*) AS total FROM balls GROUP BY 1), seen AS (SELECT batter, label, count(*) AS n FROM balls GROUP BY ALL) SELECT t.batter, l.outcome, coalesce(s.n, 0) AS n, coalesce(s.n, 0)::DOUBLE / total AS share FROM totals t CROSS JOIN labels l LEFT JOIN seen s ON s.batter = t.batter AND s.label = l.outcome")
query("q_player_overview", A.player_overview, f", bat AS (SELECT batter AS player, {BATTING} FROM balls GROUP BY 1), bowl AS (SELECT bowler AS player, {BOWLING} FROM balls GROUP BY 1) SELECT player, coalesce(runs, 0) AS runs, coalesce(balls, 0) AS balls, coalesce(dismissals, 0) AS dismissals, coalesce(innings_batted, 0) AS innings_batted, coalesce(runs_conceded, 0) AS runs_conceded, coalesce(legal_balls, 0) AS legal_balls, coalesce(wickets, 0) AS wickets, coalesce(innings_bowled, 0) AS innings_bowled, CASE WHEN coalesce(balls, 0) > 0 AND coalesce(legal_balls, 0) > 0 THEN 'all_rounder' WHEN coalesce(balls, 0) > 0 THEN 'batter' WHEN coalesce(legal_balls, 0) > 0 THEN 'bowler' ELSE 'unknown' END AS role FROM bat FULL JOIN bowl USING (player)")
query("q_player_matches_any_role", A.player_matches, ", roles AS (SELECT season_id, match_id, unnest([batter, bowler, non_striker, player_out]) AS player FROM balls) SELECT player, count(DISTINCT (season_id, match_id)) AS matches FROM roles WHERE player IS NOT NULL GROUP BY 1")
query("q_player_batting_by_season", lambda b: A.batting(b, "batter", "season_id"), _rated(BATTING, BATTING_RATES, "batter, season_id"))
query("q_player_bowling_by_season", lambda b: A.bowling(b, "bowler", "season_id"), _rated(BOWLING, BOWLING_RATES, "bowler, season_id"))
query("q_player_batting_by_phase", lambda b: A.phase_split(b, "batter", A.batting), STATE_CTE + _rated(BATTING, BATTING_RATES, "batter, phase", "phased"))
query("q_player_bowling_by_phase", lambda b: A.phase_split(b, "bowler", A.bowling), STATE_CTE + _rated(BOWLING, BOWLING_RATES, "bowler, phase", "phased"))
query("q_player_outcomes", lambda b: A.histogram(b, "batter"), f"SELECT batter, {COUNTS_SQL} FROM balls GROUP BY 1")
for _name, _p, _o, _n in (("", "batter", "bowler", 12), ("_bowling", "bowler", "batter", 8)):
    query(f"q_player_matchups{_name}", lambda b, p=_p, o=_o, n=_n: A.player_matchups(b, p, o, n), f"SELECT * FROM (SELECT {_p}, {_o}, count(*) AS deliveries, ISUM(batter_runs) AS runs, ISUM(is_wicket) AS wickets, row_number() OVER (PARTITION BY {_p} ORDER BY count(*) DESC, {_o})::INT AS position FROM balls GROUP BY {_p}, {_o}) WHERE position <= {_n} AND deliveries >= 4")
query("q_player_activity", A.player_activity, "SELECT player, count(*) AS activity FROM (SELECT batter AS player FROM balls UNION ALL SELECT bowler FROM balls) GROUP BY 1")
query("q_player_search", lambda b: A.player_search(b, "BAT 1", 20), "SELECT player FROM (SELECT batter AS player FROM balls UNION SELECT bowler FROM balls UNION SELECT non_striker FROM balls UNION SELECT player_out FROM balls WHERE player_out IS NOT NULL) WHERE replace(lower(player), ' ', '') LIKE '%bat1%' ORDER BY player LIMIT 20")
query("q_top_performers", lambda b: A.top_performers(b, SEASON, 10), f"(SELECT 'runs' AS kind, batter AS player, ISUM(batter_runs) AS value FROM balls WHERE season_id = {SEASON} GROUP BY 2 ORDER BY value DESC, player LIMIT 10) UNION ALL (SELECT 'wickets', bowler, ISUM((is_wicket = 1 AND coalesce(wicket_kind, '') NOT IN ('run out', 'retired hurt', 'retired out', 'obstructing the field'))::INT) AS value FROM balls WHERE season_id = {SEASON} GROUP BY 2 ORDER BY value DESC, 2 LIMIT 10)")
OVERVIEW = f"SELECT season_id, count(DISTINCT match_id) AS matches, count(DISTINCT ({KEYS})) AS innings, ISUM(batter_runs) AS runs, ISUM(legal_ball) AS legal_balls, count(*) FILTER (batter_runs = 4) AS fours, count(*) FILTER (batter_runs = 6) AS sixes, count(*) FILTER (legal_ball = 1 AND total_runs = 0) AS dots, ISUM(credited) AS wickets FROM balls GROUP BY 1"
query("q_season_overview", A.season_overview, f"SELECT *, RATIO(dots, legal_balls, 100) AS dot_pct FROM ({OVERVIEW})")
_BAT, _BOWL = (_rated(s, r, k, f"(SELECT * FROM balls WHERE season_id = {SEASON})") for s, r, k in ((BATTING, BATTING_RATES, "batter"), (BOWLING, BOWLING_RATES, "bowler")))
for _board, _from, _value, _order in (
    ("runs", f"SELECT batter AS player, runs AS value FROM ({_BAT})", "value", "DESC"), ("wickets", f"SELECT bowler AS player, wickets AS value FROM ({_BOWL})", "value", "DESC"),
    ("sixes", f"SELECT batter AS player, sixes AS value FROM ({_BAT})", "value", "DESC"), ("fours", f"SELECT batter AS player, fours AS value FROM ({_BAT})", "value", "DESC"),
    ("highest_score", f"SELECT batter AS player, max(score) AS value FROM (SELECT batter, {KEYS}, ISUM(batter_runs) AS score FROM balls WHERE season_id = {SEASON} GROUP BY ALL) GROUP BY 1", "value", "DESC"),
    ("strike_rate", f"SELECT batter AS player, strike_rate AS value FROM ({_BAT}) WHERE balls >= 120", "value", "DESC"), ("economy", f"SELECT bowler AS player, economy AS value FROM ({_BOWL}) WHERE legal_balls >= 120", "value", "ASC"),
):
    query(f"q_lb_{_board}", lambda b, k=_board: A.leaderboards(b, SEASON)[k], f"SELECT * FROM ({_from}) ORDER BY value {_order}, player LIMIT 10")
QUALITY = "SELECT season_id, count(DISTINCT match_id) AS matches, count(*) AS deliveries, count(*) FILTER (batter_runs = 4) AS fours, count(*) FILTER (batter_runs = 6) AS sixes, ISUM(is_wicket) AS wickets, count(*) FILTER (legal_ball = 1 AND total_runs = 0) AS dots, count(*) FILTER (legal_ball = 1 AND batter_runs = 0) AS batter_dots FROM balls GROUP BY 1"
query("q_season_quality", A.season_quality, QUALITY)
query("q_nested_quality", lambda b: ingest.nested_quality(ingest.nested(b)), QUALITY)
query("q_malformed", A.malformed, "SELECT season_id, count(*) FILTER (batter_runs + extras <> total_runs OR trim(batter) = '' OR trim(bowler) = '') AS malformed, count(*) AS deliveries FROM balls GROUP BY 1")
query("q_dot_gap_forensics", A.dot_gap, "SELECT concat_ws('+', CASE WHEN is_bye = 1 THEN 'bye' END, CASE WHEN is_leg_bye = 1 THEN 'leg_bye' END) AS kinds, total_runs, is_super_over, count(*) AS n FROM balls WHERE legal_ball = 1 AND batter_runs = 0 AND total_runs > 0 GROUP BY ALL")
query("q_median_delivery", lambda b: A.median_delivery(b, SEASON, H.CHRONOLOGY), f"SELECT {BALL}, batter, bowler, total_runs FROM (SELECT *, row_number() OVER (ORDER BY {BALL}) - 1 AS k, count(*) OVER () AS n FROM balls WHERE season_id = {SEASON}) WHERE k = n // 2")


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return A.duplicate_identities(lines, "l_returnflag", ["l_orderkey", "l_linenumber"])


QUERIES["q_duplicate_identities"] = _duplicates
ORACLES["q_duplicate_identities"] = "SELECT l_returnflag, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1"

# --- state --------------------------------------------------------------------------------------------------------------
IN = f"PARTITION BY {KEYS} ORDER BY over_number, ball_number, source_row_number"


def _w(frame: str, *parts: str) -> str:
    keys = ", ".join((KEYS, *parts))
    return f"(PARTITION BY {keys} ORDER BY over_number, ball_number, source_row_number ROWS BETWEEN {frame})"


UP_TO, BEFORE = "UNBOUNDED PRECEDING AND CURRENT ROW", "UNBOUNDED PRECEDING AND 1 PRECEDING"


def _sums(**columns: str) -> str:
    return ", ".join(f"coalesce(sum({x}) OVER w, 0)::BIGINT AS {n}" for n, x in columns.items())


query("q_innings_progression", S.innings_progression, f"SELECT {BALL}, total_runs, {_sums(score='total_runs', wickets='is_wicket')} FROM balls WINDOW w AS {_w(UP_TO)}")
query("q_score_at_delivery", S.score_at_delivery, f"SELECT *, RATIO(score, legal_balls, 6) AS run_rate FROM (SELECT {BALL}, {_sums(score='total_runs', wickets='is_wicket', legal_balls='legal_ball')} FROM balls WINDOW w AS {_w(UP_TO)})")
query("q_pre_ball_state", S.pre_ball_state, f"{STATE_CTE} SELECT {BALL}, score_before, wickets_before, legal_before, phase, label AS outcome FROM phased")
query("q_legal_balls_before", lambda b: S.with_state(b).select(*H.CHRONOLOGY, "legal_before"), f"{STATE_CTE} SELECT {BALL}, legal_before FROM stated")
query("q_pre_delivery_state", lambda b: S.with_state(b).select(*H.CHRONOLOGY, "batter", "bowler", "score_before", "wickets_before", "legal_before"), f"{STATE_CTE} SELECT {BALL}, batter, bowler, score_before, wickets_before, legal_before FROM stated")
FOUR = "(batter_runs IN (4, 6))::INT"
STRIKER = f"SELECT *, RATIO(striker_runs, striker_balls, 100) AS striker_rate FROM (SELECT {BALL}, batter, {_sums(striker_runs='batter_runs', striker_balls='1 - is_wide_ball', striker_boundaries=FOUR)} FROM balls WINDOW w AS {_w(BEFORE, 'batter')})"
SPELL = f"SELECT *, RATIO(spell_conceded, spell_balls, 6) AS spell_economy FROM (SELECT {BALL}, bowler, {_sums(spell_conceded='total_runs - bye_runs - leg_bye_runs', spell_balls='legal_ball', spell_wickets='is_wicket', spell_boundaries=FOUR)} FROM balls WINDOW w AS {_w(BEFORE, 'bowler')})"
RECENT = ", ".join(f"coalesce(sum((label = '{x}')::INT) OVER w, 0)::BIGINT AS recent_{x.replace('+', 'p')}" for x in LABELS)
RECENT = f"SELECT {BALL}, {RECENT}, coalesce(array_to_string(list(label) OVER w, ' '), '') AS recent FROM balls WINDOW w AS {_w('6 PRECEDING AND 1 PRECEDING')}"
WINDOW = f"SELECT *, RATIO(window_runs, window_legal, 6) AS window_rate FROM (SELECT {BALL}, {_sums(window_runs='total_runs', window_wickets='is_wicket', window_legal='legal_ball', window_boundaries=FOUR, window_dots='(total_runs = 0)::INT')} FROM balls WINDOW w AS {_w('12 PRECEDING AND 1 PRECEDING')})"
PAIR = f"SELECT *, RATIO(partnership_runs, partnership_balls, 100) AS partnership_rate FROM (SELECT {BALL}, wickets_before, {_sums(partnership_runs='total_runs', partnership_balls='legal_ball')} FROM stated WINDOW w AS {_w(BEFORE, 'wickets_before')})"
CHASE = f"""SELECT *, CASE WHEN required_rate - current_rate >= 2 THEN 'high' WHEN required_rate - current_rate <= -1.5 THEN 'low' ELSE 'balanced' END AS pressure,
  required_rate - current_rate AS gap FROM (SELECT {BALL}, target, greatest(120 - legal_before, 0) AS balls_remaining, greatest(10 - wickets_before, 0) AS wickets_remaining,
    CASE WHEN target IS NOT NULL AND legal_before < 120 THEN greatest(target - score_before, 0) * 6.0::DOUBLE / (120 - legal_before) END AS required_rate,
    RATIO(score_before, legal_before, 6) AS current_rate
  FROM (SELECT * FROM stated WHERE innings = 2) LEFT JOIN (SELECT season_id, match_id, ISUM(total_runs) + 1 AS target FROM balls WHERE innings = 1 GROUP BY ALL) USING (season_id, match_id))"""
query("q_striker_innings_state", S.striker_state, STRIKER)
query("q_bowler_spell_state", S.bowler_state, SPELL)
query("q_recent_outcomes", S.recent_outcomes, RECENT)
query("q_recent_window", S.recent_window, WINDOW)
query("q_partnership", S.partnership, STATE_CTE + PAIR)
query("q_chase_pressure", S.chase, STATE_CTE + CHASE)
query("q_replay_start_points", S.replay_start_points, f"{STATE_CTE} SELECT {KEYS}, over_number, ball_number, score_before, wickets_before, legal_before FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, over_number ORDER BY ball_number, source_row_number) AS k FROM stated) WHERE k = 1")
query("q_season_match_number", S.season_match_number, "SELECT season_id, match_id, dense_rank() OVER (PARTITION BY season_id ORDER BY match_id) AS match_number FROM (SELECT DISTINCT season_id, match_id FROM balls)")
query("q_chronology", S.chronology, "SELECT season_id, first_match, last_match, coalesce((lead(first_match) OVER (ORDER BY season_id) <= last_match)::INT, 0) AS overlaps FROM (SELECT season_id, min(match_id) AS first_match, max(match_id) AS last_match FROM balls GROUP BY 1)")

# --- histories ----------------------------------------------------------------------------------------------------------
SQL_KEYS = {"phase": ("over_phase",), "legal_phase": ("phase",), "venue": ("(match_id % 12)",)}


def _history(context: str, name: str, source: str) -> str:
    """SELECT of ``source`` with the context's counts before each ball, <name>_<count>."""
    keys = SQL_KEYS.get(context, H.CONTEXTS[context])
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    sums = ", ".join(f"CASE WHEN {known} THEN coalesce(sum((label = '{x}')::INT) OVER {name}, 0) ELSE 0 END::BIGINT AS {name}_{c}" for x, c in zip(LABELS, COUNTS, strict=True))
    return f"SELECT *, {sums} FROM {source} WINDOW {name} AS ({part}ORDER BY {BALL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _histories(*contexts: str, source: str = "phased") -> str:
    out, last = "", source
    for i, c in enumerate(contexts):
        out += f", h{i} AS ({_history(c, 'all_' if c == 'global' else c + '_', last)})"
        last = f"h{i}"
    return out + f", hist AS (SELECT * FROM {last})"


def _n(context: str) -> str:
    return "all_" if context == "global" else context + "_"


def _counts(context: str) -> list[str]:
    return [f"{_n(context)}_{c}" for c in COUNTS]


for _context in H.CONTEXTS:
    _named = ", ".join(f"{h} AS {c}" for h, c in zip(_counts(_context), COUNTS, strict=True))
    query(f"q_asof_{_context}", lambda b, p=None, c=_context: H.asof(b.balls if c == "venue" else b, c, p), f"{STATE_CTE}{_histories(_context)} SELECT {BALL}, {_named} FROM hist", venue=_context == "venue", plain=_context != "venue")
CAREER = "ORDER BY " + BALL + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
query("q_batter_history_asof", H.batter_history, f"SELECT *, RATIO(career_runs, career_balls, 100) AS career_rate FROM (SELECT {BALL}, batter, {_sums(career_runs='batter_runs', career_balls='1 - is_wide_ball', career_outs='coalesce((player_out = batter)::INT, 0)')} FROM balls WINDOW w AS (PARTITION BY batter {CAREER}))")
query("q_bowler_history_asof", H.bowler_history, f"SELECT *, RATIO(career_conceded, career_balls, 6) AS career_economy FROM (SELECT {BALL}, bowler, {_sums(career_conceded='total_runs - bye_runs - leg_bye_runs', career_balls='legal_ball', career_wickets='is_wicket')} FROM balls WINDOW w AS (PARTITION BY bowler {CAREER}))")
for _role, _v, _b in (("batter", "batter_runs", "1 - is_wide_ball"), ("bowler", "total_runs - bye_runs - leg_bye_runs", "legal_ball")):
    query(f"q_recent_form_{_role}", lambda b, r=_role: H.recent_form(b, r), f"SELECT {_role} AS player, season_id, match_id, count(*) OVER w AS form_matches, coalesce(sum(v) OVER w, 0)::BIGINT AS form_runs, coalesce(sum(b) OVER w, 0)::BIGINT AS form_balls FROM (SELECT {_role}, season_id, match_id, sum({_v}) AS v, sum({_b}) AS b FROM balls GROUP BY ALL) WINDOW w AS (PARTITION BY {_role} ORDER BY season_id, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")

# --- models -------------------------------------------------------------------------------------------------------------


def _size(values: list[str]) -> str:
    return "(" + " + ".join(values) + ")"


def _smooth(values: list[str]) -> list[str]:
    return [f"(({v} + 1.0)::DOUBLE / ({_size(values)} + 7.0))" for v in values]


def _top(values: list[str]) -> str:
    most = f"greatest({', '.join(values)})"
    return "CASE " + " ".join(f"WHEN {v} = {most} THEN '{x}'" for x, v in zip(LABELS[:-1], values[:-1], strict=True)) + " ELSE 'wicket' END"


def _as(values: list[str], names=PROBS) -> str:
    return ", ".join(f"{v} AS {p}" for v, p in zip(values, names, strict=True))


def _case(name_of: Callable[[str], str], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {_size(_counts(n))} >= {k} THEN {name_of(n)}" for n, k in P.BACKOFF) + f" ELSE {rest} END"


HIER_CTE = (
    ", picked AS (SELECT *, " + _case(lambda n: f"'{n}'", "'global'") + " AS level, " + _case(lambda n: _size(_counts(n)), _size(_counts("global"))) + " AS sample, "
    + ", ".join(_case(lambda n, c=c: f"{_n(n)}_{c}", f"all__{c}") + f" AS chosen_{c}" for c in COUNTS) + " FROM hist), hier AS (SELECT *, "
    + _as(_smooth([f"chosen_{c}" for c in COUNTS]), [f"hier_{p}" for p in PROBS])
    + ", CASE WHEN sample >= 100 THEN 'high' WHEN sample >= 30 THEN 'medium' ELSE 'low' END AS reliability FROM picked)"
)
HIERS = [f"hier_{p}" for p in PROBS]
_LEVELS = [n for n, _ in P.BACKOFF]
query("q_model_hierarchical", P.model_hierarchical, f"{STATE_CTE}{_histories(*_LEVELS, 'global')}{HIER_CTE} SELECT {BALL}, level, sample, reliability, {_as(HIERS)}, {_top(HIERS)} AS top, label AS actual FROM hier", plain=True)
for _name, _context in (("global", "global"), ("phase", "legal_phase")):
    _used = [f"CASE WHEN {_size(_counts(_context))} > 0 THEN {c} ELSE {g} END" for c, g in zip(_counts(_context), _counts("global"), strict=True)]
    _cols = ", ".join(f"{u} AS u_{c}" for u, c in zip(_used, COUNTS, strict=True))
    _probs = _smooth([f"u_{c}" for c in COUNTS])
    query(f"q_model_{_name}", lambda b, p, c=_context: P.baseline(b, c, p), f"{STATE_CTE}{_histories(*dict.fromkeys((_context, 'global')))}, used AS (SELECT *, {_cols} FROM hist) SELECT {BALL}, {_as(_probs)}, {_top(_probs)} AS top, label AS actual FROM used", plain=True)


def _smoothed_batters(balls: DataFrame) -> DataFrame:
    from .functions.expr import smoothed, top_label

    probs = smoothed([F.col(c) for c in COUNTS])
    return A.histogram(balls, "batter").select("batter", *P.named(probs), top_label(probs).alias("top"))


query("q_smoothed_probs", _smoothed_batters, f"SELECT batter, {_as(_smooth(list(COUNTS)))}, {_top(_smooth(list(COUNTS)))} AS top FROM (SELECT batter, {COUNTS_SQL} FROM balls GROUP BY 1)")
query("q_prediction_difference", P.prediction_difference, f"""{STATE_CTE} SELECT *, batter_changed + bowler_changed + phase_changed + wickets_before_changed + score_before_changed AS n_changed FROM (SELECT {BALL}, {', '.join(f"CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (lag({c}) OVER w IS DISTINCT FROM {c})::INT END AS {c}_changed" for c in ('batter', 'bowler', 'phase', 'wickets_before', 'score_before'))} FROM phased WINDOW w AS ({IN}))""")
