"""Queries on feature families, snapshots, ledgers and model selection; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import more_queries as Q
from . import registry as R
from .functions.expr import COUNTS, LABELS, PROBS
from .operators import evaluate as E
from .operators import features as X
from .operators import identity as N
from .registry import BALL, CUTOFF, KEYS, SEASON, STATE_CTE, VALIDATION, _as, _size, query


def _form(role: str, prefix: str, rate: str, value: str, ball: str, by: int) -> str:
    return f""", {prefix}form AS (SELECT {role}, season_id, match_id, form_balls AS {prefix}_balls, RATIO(form_runs, form_balls, {by}) AS {rate}
  FROM (SELECT {role}, season_id, match_id, coalesce(sum(v) OVER w, 0) AS form_runs, coalesce(sum(b) OVER w, 0) AS form_balls
    FROM (SELECT {role}, season_id, match_id, sum({value}) AS v, sum({ball}) AS b FROM balls GROUP BY ALL)
    WINDOW w AS (PARTITION BY {role} ORDER BY season_id, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))"""


_FORMS = _form("batter", "bat", "bat_rate", "batter_runs", "1 - is_wide_ball", 100) + _form("bowler", "bowl", "bowl_economy", "total_runs - bye_runs - leg_bye_runs", "legal_ball", 6)
_SEASON_FRAME = f"{Q.FRAME_CTE}, played AS (SELECT * FROM frame WHERE season_id = {SEASON})"
_FAMILY_FRAME = f"{_SEASON_FRAME}{_FORMS}, seen AS (SELECT *, {_size(Q._hc('recent'))} AS recent_total FROM played JOIN batform USING (batter, season_id, match_id) JOIN bowlform USING (bowler, season_id, match_id))"


def _history_family(name: str, parts: tuple[str, ...]) -> str:
    n = f"least({', '.join(_size(Q._hc(x)) for x in parts)})" if len(parts) > 1 else _size(Q._hc(parts[0]))
    source = [f"({_size([Q._part(x)[i] for x in parts])} / {len(parts)}.0::DOUBLE)" for i in range(len(PROBS))]
    inner = f"SELECT *, {n} AS n, least(0.35::DOUBLE, {n} * 0.35::DOUBLE / 250.0::DOUBLE) AS w FROM seen"
    mixed = [f"{b} * (1.0 - w) + {s} * w" for b, s in zip(R.HIERS, source, strict=True)]
    return f"SELECT {BALL}, phase AS legal_phase, label AS actual, '{name}' AS family, (n > 0)::INT AS available, n::BIGINT AS sample, {_as(mixed, [f'x_{p}' for p in PROBS])} FROM ({inner})"


def _state_family(name: str, condition: str, factors) -> str:
    probs = list(R.HIERS)
    for when, change in factors:
        for label, factor in change.items():
            probs[LABELS.index(label)] += f" * CASE WHEN ({condition}) AND ({when}) THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END"
    return f"SELECT {BALL}, phase AS legal_phase, label AS actual, '{name}' AS family, ({condition})::INT AS available, ({condition})::INT::BIGINT AS sample, {_as(probs, [f'x_{p}' for p in PROBS])} FROM seen"


_SEASON_N = _size(R._counts("season"))
_Z = [f"CASE WHEN {_SEASON_N} > 0 THEN {b} * 0.7::DOUBLE + {c}::DOUBLE / {_SEASON_N} * 0.3::DOUBLE ELSE {b} END" for b, c in zip(R.HIERS, R._counts("season"), strict=True)]
_RAW = " UNION ALL ".join(
    [_history_family(n, parts) for n, parts in X.HISTORY_FAMILIES.items()] + [_state_family(n, c, f) for n, (c, f) in X.STATE_FAMILIES.items()]
    + [f"SELECT {BALL}, phase AS legal_phase, label AS actual, 'Z' AS family, ({_SEASON_N} > 0)::INT AS available, ({_SEASON_N} > 0)::INT::BIGINT AS sample, {_as(_Z, [f'x_{p}' for p in PROBS])} FROM seen"]
)
_XS = [f"x_{p}" for p in PROBS]
FAMILY_SQL = f"{_FAMILY_FRAME}, raw AS ({_RAW}), families AS (SELECT * EXCLUDE ({', '.join(_XS)}), {_as([f'R6({x} / {_size(_XS)})' for x in _XS])} FROM raw)"
_HISTORY = ", ".join(f"'{n}'" for n in X.HISTORY_FAMILIES)


def _families(balls: DataFrame, *names: str) -> DataFrame:
    return X.families(X.family_frame(balls, SEASON), *names)


query("q_family_source", lambda b: _families(b, *X.HISTORY_FAMILIES), f"{FAMILY_SQL} SELECT * FROM families WHERE family IN ({_HISTORY})", venue=True)
query("q_family_adjust", lambda b: _families(b, *X.STATE_FAMILIES, "Z"), f"{FAMILY_SQL} SELECT * FROM families WHERE family NOT IN ({_HISTORY})", venue=True)
_FSCORED = f", scored AS (SELECT *, {Q._scores(list(PROBS))} FROM families)"
query("q_family_coverage", lambda b: X.family_coverage(_families(b)), f"{FAMILY_SQL}{_FSCORED} SELECT *, R6(available / samples::DOUBLE) AS coverage FROM (SELECT family, {Q._MEANS}, ISUM(available) AS available FROM scored GROUP BY 1)", venue=True)

_CONTEXT = Q.CONTEXT_SQL + f", judged AS MATERIALIZED (SELECT *, label AS actual FROM final WHERE season_id = {SEASON})"
_EVERY = Q.CONTEXT_SQL + ", judged AS MATERIALIZED (SELECT *, label AS actual FROM final)"
_CPS = [f"c_{p}" for p in PROBS]
_PRESSURE = "CASE WHEN gap >= 2 THEN 'high' WHEN gap <= -1.5 THEN 'low' ELSE 'balanced' END"
query("q_eval_pressure", lambda b: X.by_pressure(X.frame_of(b, SEASON)), f"{_CONTEXT} SELECT pressure, {Q._MEANS} FROM (SELECT {_PRESSURE} AS pressure, {Q._scores(_CPS)} FROM judged) GROUP BY 1", venue=True)
_CANDS = " UNION ALL ".join(
    [f"SELECT phase AS legal_phase, label AS actual, '{name}' AS candidate, " + _as([f"R6(({x}) / {_size([f'({y})' for y in xs])})" for x in xs]) + " FROM judged"
     for name, parts in X.evaluate_parts().items() for xs in [Q._blend([(f"{w}::DOUBLE", Q._part(c)) for c, w in parts], _size([f"{w}::DOUBLE" for _, w in parts]))]]
    + [f"SELECT phase AS legal_phase, label AS actual, 'combined_context' AS candidate, {_as([f'R6({c})' for c in _CPS])} FROM judged"]
)
query("q_eval_candidates", lambda b: E.metrics(X.evaluated_candidates(X.frame_of(b, SEASON)), "candidate", "legal_phase"), f"{_CONTEXT}, cands AS ({_CANDS}) SELECT candidate, legal_phase, {Q._MEANS} FROM (SELECT *, {Q._scores(list(PROBS))} FROM cands) GROUP BY 1, 2", venue=True)

_SNAP = f"""{Q.FRAME_CTE}, snap AS (SELECT {BALL}, phase, score_before, wickets_before, legal_before, current_rate, required_rate, gap,
  CASE WHEN target IS NOT NULL AND innings = 2 THEN greatest(target - score_before, 0) END AS runs_required, greatest(120 - legal_before, 0) AS balls_remaining,
  greatest(10 - wickets_before, 0) AS wickets_remaining, striker_runs, striker_balls, spell_conceded, spell_balls, partnership_runs, partnership_balls, window_runs,
  window_wickets, team_batting, team_bowling, 'Venue' || (match_id % 12) AS venue, {_size(R._counts('venue'))} AS venue_sample,
  {_size(R._counts('batter_bowler'))} AS matchup_sample, {_size(Q._hc('similar'))}::BIGINT AS similar_sample, recent FROM frame)"""
query("q_feature_snapshot", lambda b: X.snapshot(Q.P.feature_frame(b)), f"{_SNAP} SELECT * FROM snap", venue=True)
_FIELDS = (*X.TRACKED, "recent")
_CHANGED = ", ".join(f"CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (lag({c}) OVER w IS DISTINCT FROM {c})::INT END AS {c}_changed" for c in _FIELDS)
query("q_snapshot_difference", lambda b: X.snapshot_difference(X.snapshot(Q.P.feature_frame(b))), f"{_SNAP} SELECT *, ({' + '.join(f'{c}_changed' for c in _FIELDS)})::INT AS n_changed FROM (SELECT {BALL}, {_CHANGED} FROM snap WINDOW w AS (PARTITION BY {KEYS} ORDER BY over_number, ball_number, source_row_number))", venue=True)
_STRENGTH = "CASE WHEN {n} >= 1200 THEN 'high' WHEN {n} >= 250 THEN 'medium' WHEN {n} >= 40 THEN 'low' ELSE 'very_low' END"
_VENUE = "CASE WHEN {n} >= 2500 THEN 'high' WHEN {n} >= 600 THEN 'medium' WHEN {n} >= 120 THEN 'low' ELSE 'very_low' END"


def _ledger_row(feature: str, source: str, origin: str, influence: str) -> str:
    held = source in ("batter", "bowler", "batter_bowler", "similar", "venue")
    n = _size(Q._hc(source)) if held else "1"
    probs = [f"R6({v})" for v in Q._part(source)] if held else ["NULL::DOUBLE"] * len(PROBS)
    shown = f"'venue_' || {_VENUE.format(n=n)}" if influence == "venue" else f"'{influence}'"
    return f"SELECT {BALL}, '{feature}' AS feature, {'NULL' if held else source}::DOUBLE AS value, {_as(probs)}, '{origin}' AS source, {n}::BIGINT AS sample_size, {_STRENGTH.format(n=n)} AS strength, {shown} AS influence FROM played"


query("q_feature_ledger", lambda b: X.ledger(Q.P.feature_frame(b)), f"{Q.FRAME_CTE}, played AS (SELECT * FROM frame) {' UNION ALL '.join(_ledger_row(*x) for x in X.LEDGER)}", venue=True)
_MATCHUP, _SIMILAR = _size(R._counts("batter_bowler")), _size(Q._hc("similar"))
_RELIABLE = "CASE WHEN e >= 180 THEN 'high' WHEN e >= 60 THEN 'medium' WHEN e >= 20 THEN 'low' ELSE 'very_low' END"
query("q_evidence_strength", lambda b: X.evidence_strength(Q.P.feature_frame(b)), f"{Q.FRAME_CTE} SELECT * EXCLUDE (e), e AS evidence_sample, CASE WHEN e < 40 OR matchup = 0 OR comparable = 0 OR {_RELIABLE} = 'low' THEN 'LIMITED EVIDENCE' WHEN e < 120 OR {_RELIABLE} = 'medium' THEN 'MODERATE SIGNAL' ELSE 'STRONG SIGNAL' END AS strength FROM (SELECT {BALL}, {Q._EVIDENCE} AS e, {_MATCHUP} AS matchup, {_SIMILAR}::BIGINT AS comparable FROM frame)", venue=True)


def _selection(balls: DataFrame) -> DataFrame:
    runs = [E.metrics(E.long_trace(E.trace(balls, season - 1, season)), "model") for season in (VALIDATION, SEASON)]
    return X.model_selection(runs[0].unionByName(runs[1]))


def _run(season: int) -> str:
    """Scores of the three base models in one season, after a name for the CTEs of that season."""
    return f"SELECT * FROM ({Q._trace(season - 1, season).replace(STATE_CTE, 'WITH z AS (SELECT 1)', 1)}{Q._LONG}{Q._SCORED} SELECT model, {Q._MEANS} FROM scored GROUP BY 1)"


query("q_model_selection", _selection, f"{STATE_CTE}, runs AS ({_run(VALIDATION)} UNION ALL {_run(SEASON)}), means AS (SELECT model, count(*) AS windows, R6(avg(log_loss)) AS mean_log_loss, R6(avg(brier)) AS mean_brier, R6(avg(top1)) AS mean_top1, R6(max(log_loss) - min(log_loss)) AS range_log_loss, R6(max(brier) - min(brier)) AS range_brier FROM runs GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY mean_log_loss, mean_brier, range_log_loss, range_brier, mean_top1 DESC, model))::INT AS position FROM means")

# --- situations and results ---------------------------------------------------------------------------------------------
_LOW = "(legal_before // 18 * 3)"
query("q_situation_buckets", X.situation_buckets, f"{STATE_CTE} SELECT CASE WHEN wickets_before <= 2 THEN '0-2' WHEN wickets_before <= 5 THEN '3-5' ELSE '6+' END AS wickets_lost, {_LOW} || '-' || ({_LOW} + 2) AS overs, count(*) AS n, ISUM(total_runs) AS runs, ISUM(is_wicket) AS wickets FROM stated GROUP BY 1, 2")
query("q_final_states", X.final_states, f"SELECT {KEYS}, max_by(over_number, source_row_number) AS over_number, max_by(ball_number, source_row_number) AS ball_number, ISUM(total_runs) AS score, ISUM(is_wicket) AS wickets, ISUM(legal_ball) AS legal_balls FROM balls GROUP BY ALL")
query("q_result_margins", X.result_margins, """, sums AS (SELECT season_id, match_id, max(team_batting) FILTER (innings = 1) AS team_a, max(team_batting) FILTER (innings = 2) AS team_b, sum(total_runs) FILTER (innings = 1) AS a,
  sum(total_runs) FILTER (innings = 2) AS b, sum(is_wicket) FILTER (innings = 2) AS lost FROM balls GROUP BY 1, 2), won AS (SELECT season_id, match_id, CASE WHEN a > b THEN team_a WHEN b > a THEN team_b END AS winner,
  CASE WHEN a > b THEN 'runs' WHEN b > a THEN 'wickets' END AS result_type, CASE WHEN a > b THEN a - b WHEN b > a THEN greatest(10 - lost, 0) END::BIGINT AS margin FROM sums)
SELECT *, CASE WHEN winner IS NOT NULL THEN winner || ' won by ' || margin || ' ' || result_type END AS summary FROM won""")
query("q_best_phase", X.best_phase, f"{STATE_CTE}, sums AS (SELECT batter, phase, ISUM(batter_runs) AS runs, ISUM(1 - is_wide_ball) AS balls FROM phased GROUP BY 1, 2), rated AS (SELECT *, RATIO(runs, balls, 100) AS strike_rate FROM sums) SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY batter ORDER BY strike_rate DESC, CASE phase WHEN 'powerplay' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END) = 1")
query("q_longest_innings", X.longest_innings, f"SELECT {KEYS}, count(*) AS deliveries FROM balls GROUP BY ALL ORDER BY deliveries DESC, {KEYS} LIMIT 1")
query("q_venue_matches", lambda b, m: X.venue_matches(b, m, "Venue3"), "SELECT season_id, count(*) AS deliveries, ISUM(total_runs) AS runs, ISUM(is_wicket) AS wickets FROM balls WHERE match_id IN (SELECT match_id FROM meta WHERE venue = 'Venue3') GROUP BY 1", meta=True)

# --- keyed decay, joins of traces, and lookups --------------------------------------------------------------------------
for _context, _keys in (("legal_phase", "phase"), ("batter_bowler", "batter, bowler")):
    _own = ", ".join(
        f"(floor(coalesce(sum((label = '{x}')::INT * pow(0.995, -step::DOUBLE)) OVER w, 0) * pow(0.995, (step - 1)::DOUBLE) * 10000.0 + 0.5) / 10000.0) AS {c.replace('n_', 'd_')}"
        for x, c in zip(LABELS, COUNTS, strict=True)
    )
    query(f"q_decayed_{_context}", lambda b, c=_context: E.decayed_counts(b, 0.995, c), f"{STATE_CTE}, steps AS (SELECT *, row_number() OVER (ORDER BY {BALL}) - 1 AS step FROM phased) SELECT {BALL}, step, {_own} FROM steps WINDOW w AS (PARTITION BY {_keys} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
_CAME = "CASE actual " + " ".join(f"WHEN '{x}' THEN hierarchical_{p}" for x, p in zip(LABELS, PROBS, strict=True)) + " END"
_INNER = "WITH z AS (SELECT 1)"
query(
    "q_trace_join", lambda b: X.trace_join(E.trace(b, CUTOFF, VALIDATION), E.trace(b, CUTOFF, VALIDATION, 0.995)),
    f"{STATE_CTE} SELECT legal_phase, count(*) AS n, R6(avg(after - before)) AS change FROM (SELECT * FROM ({Q._trace(CUTOFF, VALIDATION).replace(STATE_CTE, _INNER, 1)} SELECT {BALL}, legal_phase, {_CAME} AS before FROM trace)) JOIN (SELECT * FROM ({Q._aged(0.995, CUTOFF, VALIDATION).replace(STATE_CTE, _INNER, 1)} SELECT {BALL}, {_CAME} AS after FROM trace)) USING ({BALL}) GROUP BY 1",
)
query("q_innings_with_player", lambda b: X.innings_with(b, "Bat1"), f"{STATE_CTE} SELECT season_id, phase, count(*) AS n, ISUM(total_runs) AS runs, ISUM(is_wicket) AS wickets FROM phased WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM balls WHERE batter = 'Bat1') GROUP BY 1, 2")
query("q_phases_in_order", lambda b: X.phases_in_order(b, SEASON), f"{STATE_CTE} SELECT (CASE phase WHEN 'powerplay' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END)::INT AS place, phase, count(*) AS n, ISUM(total_runs) AS runs FROM phased WHERE season_id = {SEASON} GROUP BY 2 ORDER BY 1")
query("q_first_match", lambda b, m: X.first_match(m, "Team1"), "SELECT season_id, match_id, venue, team_a, team_b, winner, match_type, match_date FROM meta WHERE team_a = 'Team1' OR team_b = 'Team1' ORDER BY match_date, match_id LIMIT 1", meta=True)
query("q_without_matches", lambda b: X.without_matches(b, [199501, 199602]), "SELECT season_id, count(*) AS deliveries FROM balls WHERE match_id NOT IN (199501, 199602) GROUP BY 1")
_PARTS = " UNION ALL ".join(f"SELECT {BALL}, '{n}' AS component, R6(w_{n} / w_total) AS share FROM judged" for n in Q._WEIGHTS)
query("q_blend_contributions", lambda b: X.blend_contributions(Q.P.feature_frame(b)), f"{_EVERY} SELECT * FROM ({_PARTS}) WHERE share > 0", venue=True)
_RS = [f"R6(b_{p})" for p in PROBS]
_FIXED = ", ".join(f"r_{p} + CASE WHEN top_of = '{x}' THEN rest ELSE 0.0 END AS {p}" for p, x in zip(PROBS, LABELS, strict=True))
_RP = [f"r_{p}" for p in PROBS]
query(
    "q_exact_blend", lambda b: X.exact_blend(Q.P.feature_frame(b)),
    f"{_EVERY}, rounded AS (SELECT {BALL}, {_as(_RS, _RP)} FROM judged), fixed AS (SELECT {BALL}, {_FIXED} FROM (SELECT *, {R._top(_RP)} AS top_of, R6(1.0::DOUBLE - {_size(_RP)}) AS rest FROM rounded)) SELECT *, {R._top(list(PROBS))} AS top FROM fixed",
    venue=True,
)

# --- names --------------------------------------------------------------------------------------------------------------
_QUESTIONS = ("Bat1", "bat", "OWL2", "Bowl12", "nobody", "bowl 3", "b", "")
_PLAYERS = "SELECT batter AS player FROM balls UNION SELECT bowler FROM balls"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_ALIASES = f"""SELECT DISTINCT alias, player, 'derived' AS status FROM (SELECT player, unnest([player, {_NORM.format('player')}, replace({_NORM.format('player')}, ' ', ''),
  string_split({_NORM.format('player')}, ' ')[-1]]) AS alias FROM ({_PLAYERS})) WHERE alias <> ''"""


def _players(balls: DataFrame) -> DataFrame:
    return balls.select("batter").union(balls.select("bowler")).toDF("player").distinct()


def _asked(balls: DataFrame) -> DataFrame:
    return balls.sparkSession.createDataFrame([(q,) for q in _QUESTIONS], "query string")


query("q_alias_index", lambda b: N.aliases(_players(b)), _ALIASES.replace("SELECT DISTINCT", "SELECT DISTINCT", 1))
query(
    "q_resolve_players", lambda b: N.resolved(_asked(b), N.aliases(_players(b)), R.A.player_activity(b)),
    f""", asked AS (SELECT DISTINCT query, {_NORM.format('query')} AS asked FROM (SELECT unnest({list(_QUESTIONS)!r}) AS query)),
activity AS (SELECT player, count(*) AS n FROM (SELECT batter AS player FROM balls UNION ALL SELECT bowler FROM balls) GROUP BY 1),
met AS (SELECT query, asked, player, {_NORM.format('alias')} AS form FROM ({_ALIASES}) JOIN asked ON asked <> '' AND contains({_NORM.format('alias')}, asked)),
scores AS (SELECT query, player, max(25.0::DOUBLE + CASE WHEN form = asked THEN 120 WHEN starts_with(form, asked) THEN 35 ELSE 18 END
  + 16 * len(list_intersect(string_split(asked, ' '), string_split({_NORM.format('player')}, ' '))) + least(coalesce(n, 0), 5000) / 250.0::DOUBLE) AS score FROM met LEFT JOIN activity USING (player) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, player) AS k FROM scores),
best AS (SELECT query, max(score) FILTER (k = 1) AS top, max(score) FILTER (k = 2) AS second, max(player) FILTER (k = 1) AS first, string_agg(player, '|' ORDER BY k) FILTER (k <= 8) AS candidates FROM ranked GROUP BY 1)
SELECT a.query, CASE WHEN second IS NULL OR (top >= 130 AND top >= second + 24) THEN first END AS player, candidates FROM asked a LEFT JOIN best b ON b.query = a.query""",
)
