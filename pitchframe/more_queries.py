"""Queries on matches, evaluation and trust; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registry as R
from .functions.expr import COUNTS, LABELS, PROBS
from .operators import aggregates as A
from .operators import evaluate as E
from .operators import evidence as H
from .operators import matches as M
from .operators import models as P
from .operators import trust as T
from .registry import BALL, CUTOFF, KEYS, OVERVIEW, QUALITY, SEASON, STATE_CTE, VALIDATION, _as, _counts, _histories, _n, _size, _smooth, query

# --- matches ------------------------------------------------------------------------------------------------------------
NRR = f""", sides2 AS (
  SELECT {KEYS}, max(team_batting) AS team, sum(total_runs) AS runs, CASE WHEN sum(is_wicket) >= 10 THEN 120 ELSE sum(legal_ball) END AS faced
  FROM balls WHERE innings IN (1, 2) GROUP BY ALL
), nrr AS (
  SELECT a.season_id, a.team, ISUM(a.runs) AS runs, ISUM(a.faced) AS faced, ISUM(b.runs) AS against, ISUM(b.faced) AS bowled
  FROM sides2 a JOIN sides2 b ON a.season_id = b.season_id AND a.match_id = b.match_id AND a.innings <> b.innings GROUP BY 1, 2
), rates AS (SELECT *, RATIO(runs, faced, 6) - RATIO(against, bowled, 6) AS nrr FROM nrr)"""
query("q_net_run_rate", M.net_run_rate, f"{NRR} SELECT * FROM rates")
query("q_points_table", M.points_table, f"""{NRR}, entries AS (SELECT season_id, winner, unnest([team_a, team_b]) AS team FROM meta)
SELECT e.*, coalesce(nrr, 0.0) AS nrr FROM (SELECT season_id, team, count(*) AS played, count(*) FILTER (winner = team) AS won, count(*) FILTER (winner <> team) AS lost,
  count(*) FILTER (winner IS NULL) AS no_result, ISUM(CASE WHEN winner = team THEN 2 WHEN winner IS NULL THEN 1 ELSE 0 END) AS points
  FROM entries WHERE team IS NOT NULL GROUP BY 1, 2) e LEFT JOIN rates USING (season_id, team)""".replace("coalesce(nrr", "coalesce(rates.nrr"), meta=True)
query("q_scorecard_batting", M.scorecard_batting, f"SELECT *, RATIO(runs, balls, 100) AS strike_rate FROM (SELECT {KEYS}, batter, ISUM(batter_runs) AS runs, count(*) FILTER (is_wide_ball = 0) AS balls, count(*) FILTER (batter_runs = 4) AS fours, count(*) FILTER (batter_runs = 6) AS sixes, CASE WHEN count(*) FILTER (player_out = batter) > 0 THEN 'out' ELSE 'not out' END AS status FROM balls GROUP BY {KEYS}, batter)")
query("q_scorecard_bowling", M.scorecard_bowling, f"SELECT *, RATIO(runs, legal_balls, 6) AS economy FROM (SELECT {KEYS}, bowler, ISUM(legal_ball) AS legal_balls, ISUM(total_runs - bye_runs - leg_bye_runs) AS runs, ISUM(is_wicket) AS wickets FROM balls GROUP BY {KEYS}, bowler)")
query("q_match_top_performers", M.match_top_performers, ", bat AS (SELECT season_id, match_id, batter, ISUM(batter_runs) AS runs FROM balls GROUP BY ALL), bowl AS (SELECT season_id, match_id, bowler, ISUM(is_wicket) AS wickets FROM balls GROUP BY ALL) SELECT season_id, match_id, top_batter, runs, top_bowler, wickets FROM (SELECT season_id, match_id, batter AS top_batter, runs FROM bat QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY runs DESC, batter) = 1) JOIN (SELECT season_id, match_id, bowler AS top_bowler, wickets FROM bowl QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY wickets DESC, bowler) = 1) USING (season_id, match_id)")
SWING = "SELECT *, innings_2 - innings_1 AS swing FROM (SELECT season_id, match_id, CAST(sum(total_runs) FILTER (innings = 1) AS BIGINT) AS innings_1, CAST(sum(total_runs) FILTER (innings = 2) AS BIGINT) AS innings_2 FROM balls GROUP BY 1, 2)"
query("q_innings_swing", M.innings_swing, SWING)
query("q_team_squad", M.team_squad, "SELECT season_id, team, player, ISUM(touch) AS touches, count(DISTINCT match_id) AS matches FROM (SELECT season_id, match_id, team_batting AS team, batter AS player, 1 AS touch FROM balls UNION ALL SELECT season_id, match_id, team_bowling, bowler, 1 FROM balls UNION ALL SELECT season_id, match_id, team_batting, non_striker, 0 FROM balls) GROUP BY 1, 2, 3 HAVING sum(touch) > 0")
query("q_list_seasons", M.list_seasons, "SELECT season_id, count(DISTINCT match_id) AS matches, count(*) AS deliveries, count(DISTINCT team_batting) AS teams FROM balls GROUP BY 1")
query("q_list_matches", M.list_matches, "SELECT season_id, match_id, dense_rank() OVER (PARTITION BY season_id ORDER BY match_id) AS match_number, deliveries, innings, team_a, team_b, venue, winner FROM (SELECT season_id, match_id, count(*) AS deliveries, count(DISTINCT innings) AS innings FROM balls GROUP BY 1, 2) JOIN meta USING (season_id, match_id)", meta=True)
query("q_list_innings", lambda b: A.innings_summary(b).select("match_id", "innings", "team_batting", "deliveries", "runs"), "SELECT match_id, innings, team_batting, count(*) AS deliveries, ISUM(total_runs) AS runs FROM balls GROUP BY ALL")
query("q_match_detail", M.match_detail, f"SELECT * FROM meta JOIN ({SWING}) USING (season_id, match_id)", meta=True)
query("q_match_search", lambda b, m: M.match_search(m, "venue3", "Team1"), "SELECT season_id, match_id, venue, team_a, team_b, winner FROM meta WHERE concat_ws(' ', lower(venue), lower(team_a), lower(team_b), lower(winner)) LIKE '%venue3%' AND (team_a = 'Team1' OR team_b = 'Team1')", meta=True)
query("q_fixtures", lambda b, m: M.fixtures(m, "2000-01-01"), "SELECT season_id, match_id, team_a, team_b, CASE WHEN coalesce(winner, '') <> '' THEN 'completed' WHEN match_date >= DATE '2000-01-01' THEN 'upcoming' ELSE 'scheduled' END AS status FROM meta", meta=True)
query("q_results", lambda b, m: M.results(m), "SELECT season_id, match_id, winner, match_type FROM meta WHERE winner IS NOT NULL", meta=True)
_MOVES = " UNION ALL ".join(f"SELECT '{c}' AS metric, max({c}) FILTER (season_id = {VALIDATION}) AS before, max({c}) FILTER (season_id = {SEASON}) AS after FROM o" for c in ("matches", "runs", "legal_balls", "fours", "sixes", "dots", "wickets"))
query("q_season_compare", lambda b: M.season_compare(A.season_overview(b), VALIDATION, SEASON), f", o AS ({OVERVIEW}) SELECT *, after - before AS shift FROM ({_MOVES})")

# --- contextual models --------------------------------------------------------------------------------------------------
CONTEXTS = ("batter", "bowler", "batter_bowler", "batter_bowler_type", "bowler_batter_type", "types", "phase", "team_batting", "team_bowling", "venue", "season", "legal_phase", "global")


def _similar(level: int) -> str:
    """Counts by ball of earlier similar balls, by an explicit join of each ball with the running sums of its keys."""
    keys, _ = H.SIMILAR[level]
    last = level == len(H.SIMILAR) - 1
    at = "over_phase" if last else "over_number"
    probes = f"phase AS place, 1 AS asks" if last else "unnest([(legal_before // 18) * 3, (legal_before // 18) * 3 + 1, (legal_before // 18) * 3 + 2]) AS place, 1 AS asks"
    cols = ", ".join(dict.fromkeys((*BALL.split(", "), *keys)))
    facts = ", ".join(f"(label = '{x}')::INT AS {c}" for x, c in zip(LABELS, COUNTS, strict=True))
    sums = ", ".join(f"coalesce(sum({c}) OVER w, 0) AS {c}" for c in COUNTS)
    zero = ", ".join(f"0 AS {c}" for c in COUNTS)
    totals = ", ".join(f"sum({c})::BIGINT AS s{level}_{c}" for c in COUNTS)
    return f""", every{level} AS MATERIALIZED (SELECT {cols}, {at} AS place, 0 AS asks, {facts} FROM phased UNION ALL SELECT {cols}, {probes}, {zero} FROM phased),
  run{level} AS (SELECT {cols}, asks, {sums} FROM every{level} WINDOW w AS (PARTITION BY {', '.join(keys)}, place ORDER BY {BALL}, asks DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sim{level} AS MATERIALIZED (SELECT {BALL}, {totals} FROM run{level} WHERE asks = 1 AND batsman_type IS NOT NULL AND bowler_type IS NOT NULL GROUP BY {BALL})"""


_NS = [f"coalesce({_size([f's{i}_{c}' for c in COUNTS])}, 0)" for i in range(2)]
_LEVEL = f"CASE WHEN {_NS[0]} >= 120 THEN 0 WHEN {_NS[1]} >= 220 THEN 1 ELSE 2 END"
_SIMS = ", ".join(f"coalesce(CASE {_LEVEL} WHEN 0 THEN s0_{c} WHEN 1 THEN s1_{c} ELSE s2_{c} END, 0) AS similar_{c}" for c in COUNTS)
SIMILAR_CTE = "".join(map(_similar, range(3)))
query("q_similar_situations", lambda b: H.similar_situations(H.labelled(b)).select(*H.CHRONOLOGY, "similar_level", *(f"similar_{c}" for c in COUNTS)), f"{STATE_CTE}{SIMILAR_CTE} SELECT {BALL}, {_LEVEL} AS similar_level, {_SIMS} FROM phased LEFT JOIN sim0 USING ({BALL}) LEFT JOIN sim1 USING ({BALL}) LEFT JOIN sim2 USING ({BALL})")

_RECENT = ", ".join(f"recent_{x.replace('+', 'p')} AS recent_{c}" for x, c in zip(LABELS, COUNTS, strict=True))
FRAME_CTE = f"""{STATE_CTE}{SIMILAR_CTE}{_histories(*CONTEXTS)}{R.HIER_CTE}, striker AS ({R.STRIKER}), spell AS ({R.SPELL}), rec AS ({R.RECENT}), win AS ({R.WINDOW}), pair AS ({R.PAIR}), chase AS ({R.CHASE}),
frame AS (SELECT hier.*, {_SIMS}, {_RECENT}, recent_4 + recent_6 AS fours, recent_4, recent_6, recent_wicket, recent, striker_runs, striker_balls, striker_rate, spell_conceded, spell_balls, spell_economy,
  partnership_runs, partnership_balls, partnership_rate, window_runs, window_wickets, window_legal, window_rate, target, required_rate, gap, RATIO(score_before, legal_before, 6) AS current_rate
  FROM hier LEFT JOIN sim0 USING ({BALL}) LEFT JOIN sim1 USING ({BALL}) LEFT JOIN sim2 USING ({BALL}) JOIN striker USING ({BALL}) JOIN spell USING ({BALL}) JOIN rec USING ({BALL}) JOIN win USING ({BALL}) JOIN pair USING ({BALL}) LEFT JOIN chase USING ({BALL}))"""


def _hc(name: str) -> list[str]:
    return [f"{name}_{c}" for c in COUNTS] if name in ("similar", "recent") else _counts(name)


def _part(name: str) -> list[str]:
    return list(R.HIERS) if name == "hierarchical" else _smooth(_hc(name))


def _blend(parts: list[tuple[str, list[str]]], total: str) -> list[str]:
    return [_size([f"({w}) / {total} * {p[i]}" for w, p in parts]) for i in range(len(LABELS))]


_WEIGHTS = {n: (f"{cap}::DOUBLE" if enough is None else f"least({cap}::DOUBLE, {_size(_hc(n))} * {cap}::DOUBLE / {float(enough)}::DOUBLE)") for n, cap, enough in P.BLEND}
_SHARES = {"n": "", "v": _size(_smooth(_hc("venue"))), "m": ""}
# The limits and factors of the contextual model, for the SQL.
_CHANGES = [
    ("gap >= 2.0", {"4": 1.12, "6": 1.10, "wicket": 1.08, "0": 0.92}), ("gap <= -1.5", {"0": 1.06, "1": 1.08, "4": 0.95, "6": 0.90}),
    ("10 - wickets_before <= 3", {"wicket": 1.08, "0": 1.04, "6": 0.95}), ("striker_balls >= 6 AND striker_rate >= 150", {"4": 1.08, "6": 1.10}),
    ("striker_balls >= 6 AND striker_rate <= 90", {"0": 1.05, "1": 1.04, "wicket": 1.04}), ("spell_balls >= 6 AND spell_economy >= 10", {"4": 1.07, "6": 1.06}),
    ("spell_balls >= 6 AND spell_economy <= 6", {"0": 1.06, "wicket": 1.05}), ("fours >= 2", {"4": 1.05, "6": 1.05}), ("recent_wicket >= 1", {"wicket": 1.06}),
    ("partnership_balls >= 12 AND partnership_rate >= 150", {"1": 1.05, "4": 1.06}), ("window_legal >= 6 AND window_rate <= 5", {"0": 1.05, "wicket": 1.03}),
    ("window_legal >= 6 AND window_rate >= 10", {"4": 1.06, "6": 1.05}), (f"{_size(_hc('venue'))} >= 600 AND {_smooth(_hc('venue'))[5]} >= 0.03", {"6": 1.03}),
    (f"{_size(_hc('batter_bowler'))} >= 20 AND {_smooth(_hc('batter_bowler'))[6]} >= 0.1", {"wicket": 1.08}),
]


def _adjusted(probs: list[str]) -> list[str]:
    out = list(probs)
    for condition, change in _CHANGES:
        for label, factor in change.items():
            i = LABELS.index(label)
            out[i] += f" * CASE WHEN {condition} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END"
    return out


_W = ", ".join(f"{w} AS w_{n}" for n, w in _WEIGHTS.items())
_TOTAL = _size([f"w_{n}" for n in _WEIGHTS])
_BLENDED = _blend([(f"w_{n}", _part(n)) for n in _WEIGHTS], "w_total")
_EVIDENCE = f"({_size(_hc('batter_bowler'))} + {_size(_hc('similar'))} + least({_size(_hc('batter'))}, 400) + least({_size(_hc('bowler'))}, 400) + {_size(_hc('recent'))})::BIGINT"
CONTEXT_SQL = f"""{FRAME_CTE}, weighted AS (SELECT *, {_W} FROM frame), summed AS (SELECT *, {_TOTAL} AS w_total FROM weighted),
raw AS (SELECT *, {_as(_BLENDED, [f'x_{p}' for p in PROBS])} FROM summed), shares AS (SELECT *, {_as([f"x_{p} / {_size([f'x_{q}' for q in PROBS])}" for p in PROBS], [f'b_{p}' for p in PROBS])} FROM raw),
changed AS (SELECT *, {_as(_adjusted([f'b_{p}' for p in PROBS]), [f'y_{p}' for p in PROBS])} FROM shares), final AS (SELECT *, {_as([f"y_{p} / {_size([f'y_{q}' for q in PROBS])}" for p in PROBS], [f'c_{p}' for p in PROBS])} FROM changed)"""
query("q_model_contextual", P.model_contextual, f"{CONTEXT_SQL} SELECT {BALL}, {_as([f'R6(c_{p})' for p in PROBS])}, {_EVIDENCE} AS evidence_sample, label AS actual FROM final", venue=True)
query("q_contextual_blend", lambda b: P.contextual(P.feature_frame(b)).select(*H.CHRONOLOGY, *(P.rounded(F.col(f"b_{p}")).alias(p) for p in PROBS)), f"{CONTEXT_SQL} SELECT {BALL}, {_as([f'R6(b_{p})' for p in PROBS])} FROM final", venue=True)
query("q_context_multipliers", lambda b: P.contextual(P.feature_frame(b)).select(*H.CHRONOLOGY, *(P.rounded(F.col(f"c_{p}") / F.col(f"b_{p}")).alias(f"factor_{p}") for p in PROBS)), f"{CONTEXT_SQL} SELECT {BALL}, {_as([f'R6(c_{p} / b_{p})' for p in PROBS], [f'factor_{p}' for p in PROBS])} FROM final", venue=True)
_STRENGTH = "CASE WHEN evidence_sample >= 1200 THEN 'high' WHEN evidence_sample >= 250 THEN 'medium' WHEN evidence_sample >= 40 THEN 'low' ELSE 'very_low' END"


def _strength(balls: DataFrame) -> DataFrame:
    from .functions.expr import FEATURE_STRENGTH, tier

    return P.contextual(P.feature_frame(balls)).select(*H.CHRONOLOGY, "evidence_sample", tier("evidence_sample", *FEATURE_STRENGTH).alias("strength"))


query("q_evidence_sample", _strength, f"{FRAME_CTE} SELECT *, {_STRENGTH} AS strength FROM (SELECT {BALL}, {_EVIDENCE} AS evidence_sample FROM frame)", venue=True)
_CANDIDATE_SQL = " UNION ALL ".join(
    f"SELECT {BALL}, label, '{name}' AS candidate, " + _as([f"R6(({x}) / {_size([f'({y})' for y in xs])})" for x in xs]) + " FROM frame"
    for name, parts in P.CANDIDATES.items()
    for xs in [_blend([(f"{w}::DOUBLE", _part(c)) for c, w in parts], _size([f"{w}::DOUBLE" for _, w in parts]))]
)
query("q_candidate_blends", lambda b: P.candidate_blends(P.feature_frame(b)), f"{FRAME_CTE} {_CANDIDATE_SQL}", venue=True)

# --- evaluation ---------------------------------------------------------------------------------------------------------
_PHASED = [f"CASE WHEN {_size(_counts('legal_phase'))} > 0 THEN {c} ELSE {g} END" for c, g in zip(_counts("legal_phase"), _counts("global"), strict=True)]


def _trace(cutoff: int, season: int, hist: str | None = None) -> str:
    probs = {"global": _smooth(_counts("global")), "phase": _smooth([f"u_{c}" for c in COUNTS]), "hierarchical": R.HIERS}
    cols = ", ".join(f"{v} AS {m}_{p}" for m, vs in probs.items() for p, v in zip(PROBS, vs, strict=True))
    span = f", span AS (SELECT * FROM phased WHERE season_id <= {cutoff} OR season_id = {season})"
    used = ", used AS (SELECT *, " + ", ".join(f"{u} AS u_{c}" for u, c in zip(_PHASED, COUNTS, strict=True)) + " FROM hier)"
    hist = hist or span + _histories(*E.READ, source="span")
    return f"{STATE_CTE}{hist}{R.HIER_CTE}{used}, trace AS (SELECT {BALL}, label AS actual, phase AS legal_phase, level, sample, reliability, {cols} FROM used WHERE season_id = {season})"


_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT actual, legal_phase, reliability, '{m}' AS model, {_as([f'{m}_{p}' for p in PROBS])} FROM trace" for m in E.MODELS) + ")"


def _scores(ps: list[str]) -> str:
    own = "CASE actual " + " ".join(f"WHEN '{x}' THEN {p}" for x, p in zip(LABELS, ps, strict=True)) + " END"
    brier = _size([f"pow({p} - (actual = '{x}')::INT, 2)" for x, p in zip(LABELS, ps, strict=True)]) + " / 7"
    better = " + ".join(f"(actual <> '{x}' AND ({p} > {own} OR ({p} = {own} AND '{x}' < actual)))::INT" for x, p in zip(LABELS, ps, strict=True))
    return f"-ln(greatest({own}, 1e-15)) AS log_loss, {brier} AS brier, 1 + {better} AS position"


_SCORED = f", scored AS (SELECT *, {_scores(list(PROBS))} FROM long)"
_MEANS = "count(*) AS samples, R6(avg(log_loss)) AS log_loss, R6(avg(brier)) AS brier, R6(avg((position = 1)::INT)) AS top1, R6(avg((position <= 3)::INT)) AS top3"


def _long(balls: DataFrame) -> DataFrame:
    return E.long_trace(E.trace(balls, CUTOFF, SEASON))


_T = _trace(CUTOFF, SEASON) + _LONG + _SCORED
query("q_eval_metrics", lambda b: E.metrics(_long(b), "model"), f"{_T} SELECT model, {_MEANS} FROM scored GROUP BY 1")
query("q_eval_by_phase", lambda b: E.metrics(_long(b), "model", "legal_phase"), f"{_T} SELECT model, legal_phase, {_MEANS} FROM scored GROUP BY 1, 2")
query("q_eval_by_outcome", lambda b: E.metrics(_long(b), "model", "actual"), f"{_T} SELECT model, actual, {_MEANS} FROM scored GROUP BY 1, 2")
query("q_eval_by_evidence", lambda b: E.metrics(_long(b).where("model = 'hierarchical'"), "reliability"), f"{_T} SELECT reliability, {_MEANS} FROM scored WHERE model = 'hierarchical' GROUP BY 1")
query("q_eval_deltas", lambda b: E.deltas(E.metrics(_long(b), "model")), f"{_T}, m AS (SELECT model, {_MEANS} FROM scored GROUP BY 1) SELECT m.model, R6(m.log_loss - g.log_loss) AS loss_delta, R6((m.log_loss - g.log_loss) / g.log_loss) AS loss_change, R6(m.brier - g.brier) AS brier_delta FROM m CROSS JOIN (SELECT * FROM m WHERE model = 'global') g")
query("q_calibration", lambda b: E.calibration(_long(b)), f"{_T}, bins AS (SELECT model, least(floor(greatest({', '.join(PROBS)}) * 5), 4)::INT AS bin, greatest({', '.join(PROBS)}) AS c, position FROM scored), sums AS (SELECT model, bin, count(*) AS n, R6(avg(c)) AS confidence, R6(avg((position = 1)::INT)) AS accuracy FROM bins GROUP BY 1, 2) SELECT a.model, b.bin, coalesce(n, 0) AS n, coalesce(confidence, 0.0) AS confidence, coalesce(accuracy, 0.0) AS accuracy FROM (SELECT DISTINCT model FROM scored) a CROSS JOIN (SELECT unnest(range(5))::INT AS bin) b LEFT JOIN sums s ON s.model = a.model AND s.bin = b.bin")
query("q_sample_buckets", lambda b: E.sample_buckets(E.trace(b, CUTOFF, SEASON)), f"{_trace(CUTOFF, SEASON)} SELECT CASE WHEN sample >= 1000 THEN '1000+' WHEN sample >= 300 THEN '300-999' WHEN sample >= 100 THEN '100-299' WHEN sample >= 30 THEN '30-99' ELSE '0-29' END AS bucket, count(*) AS n FROM trace GROUP BY 1")
_GRID = "SELECT i / {u}::DOUBLE AS w_global, j / {u}::DOUBLE AS w_phase, ({u} - i - j) / {u}::DOUBLE AS w_hierarchical FROM (SELECT unnest(range({u} + 1)) AS i) CROSS JOIN (SELECT unnest(range({u} + 1)) AS j) WHERE i + j <= {u}"
query("q_weight_grid", lambda b: E.weight_grid(b.sparkSession, 0.05), f", g AS (SELECT 1) {_GRID.format(u=20)}")
_MIX = _scores([f"m_{p}" for p in PROBS])
_MIXED = ", ".join(f"w_global * global_{p} + w_phase * phase_{p} + w_hierarchical * hierarchical_{p} AS m_{p}" for p in PROBS)
_TUNED = f"{_trace(CUTOFF, VALIDATION)}, grid AS ({_GRID.format(u=10)}), mixed AS (SELECT actual, w_global, w_phase, w_hierarchical, {_MIXED} FROM trace CROSS JOIN grid), tuned AS (SELECT w_global, w_phase, w_hierarchical, R6(avg(log_loss)) AS log_loss, R6(avg(brier)) AS brier FROM (SELECT *, {_MIX} FROM mixed) GROUP BY 1, 2, 3)"
query("q_mixture", lambda b: E.tune(E.trace(b, CUTOFF, VALIDATION), 0.1), f"{_TUNED} SELECT * FROM tuned")
query("q_tune_mixture", lambda b: E.best_weights(E.tune(E.trace(b, CUTOFF, VALIDATION), 0.1)), f"{_TUNED} SELECT * FROM tuned ORDER BY log_loss, brier, w_phase DESC, w_hierarchical DESC, w_global DESC LIMIT 1")
query("q_leakage_audit", lambda b: E.leakage_audit(b, CUTOFF, SEASON), f"SELECT count(*) FILTER (season_id <= {CUTOFF}) AS train_rows, count(*) FILTER (season_id = {SEASON}) AS eval_rows, (max(season_id) FILTER (season_id <= {CUTOFF}) < {SEASON})::INT AS no_leak FROM balls")
_STEP = f"SELECT *, row_number() OVER (ORDER BY {BALL}) - 1 AS step FROM balls"
# Powers are taken within blocks of a thousand balls, to which the totals of all earlier blocks are added.
_BLOCKS = ", ".join(f"sum((label = '{x}')::INT * pow(0.995, (999 - step % 1000)::DOUBLE)) AS b_{c}" for x, c in zip(LABELS, COUNTS, strict=True))
_FAR = ", ".join(f"coalesce((SELECT sum(b_{c} * pow(0.995, ((s.block - b.block - 1) * 1000)::DOUBLE)) FROM blocks b WHERE b.block < s.block), 0) AS f_{c}" for c in COUNTS)
_NEAR = ", ".join(
    f"(floor((coalesce(sum((label = '{x}')::INT * pow(0.995, -(step % 1000)::DOUBLE)) OVER w, 0) * pow(0.995, (step % 1000 - 1)::DOUBLE) + f_{c} * pow(0.995, (step % 1000)::DOUBLE)) * 10000.0 + 0.5) / 10000.0) AS {c.replace('n_', 'd_')}"
    for x, c in zip(LABELS, COUNTS, strict=True)
)
query("q_decayed_counts", E.decayed_counts, f", steps AS ({_STEP}), blocks AS (SELECT step // 1000 AS block, {_BLOCKS} FROM steps GROUP BY 1), far AS (SELECT s.block, {_FAR} FROM (SELECT DISTINCT block FROM blocks) s) SELECT {BALL}, step, {_NEAR} FROM (SELECT *, step // 1000 AS block FROM steps) JOIN far USING (block) WINDOW w AS (PARTITION BY block ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def _aged(decay: float, cutoff: int, season: int) -> str:
    """The trace's CTEs with decayed counts in place of plain ones: powers of the step since the first ball."""
    spans = f", span AS (SELECT *, row_number() OVER (ORDER BY {BALL}) - 1 AS step FROM phased WHERE season_id <= {cutoff} OR season_id = {season})"
    out, last = "", "span"
    for i, context in enumerate(E.READ):
        keys, name = R.SQL_KEYS.get(context, H.CONTEXTS[context]), "all_" if context == "global" else context + "_"
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
        part = f"PARTITION BY {', '.join(keys)} " if keys else ""
        sums = ", ".join(f"CASE WHEN {known} THEN coalesce(sum((label = '{x}')::INT * pow({decay}, -step::DOUBLE)) OVER {name}, 0) * pow({decay}, (step - 1)::DOUBLE) ELSE 0 END AS {name}_{c}" for x, c in zip(LABELS, COUNTS, strict=True))
        out += f", h{i} AS (SELECT *, {sums} FROM {last} WINDOW {name} AS ({part}ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        last = f"h{i}"
    return _trace(cutoff, season, f"{spans}{out}, hist AS (SELECT * FROM {last})")


def _tuned(decay: float) -> str:
    plain = _trace(CUTOFF, VALIDATION) if decay == 1.0 else _aged(decay, CUTOFF, VALIDATION)
    return f"SELECT {decay}::DOUBLE AS recency_decay, * FROM ({plain.replace(STATE_CTE, 'WITH z AS (SELECT 1)', 1)}, grid AS ({_GRID.format(u=20)}), mixed AS (SELECT actual, w_global, w_phase, w_hierarchical, {_MIXED} FROM trace CROSS JOIN grid) SELECT w_global, w_phase, w_hierarchical, R6(avg(log_loss)) AS log_loss, R6(avg(brier)) AS brier FROM (SELECT *, {_MIX} FROM mixed) GROUP BY 1, 2, 3 ORDER BY log_loss, brier, w_phase DESC, w_hierarchical DESC, w_global DESC LIMIT 1)"


query("q_tune_decay", lambda b: E.tune_decay(b, VALIDATION, SEASON), f"{STATE_CTE} SELECT *, (row_number() OVER (ORDER BY log_loss, brier, abs(1.0 - recency_decay), w_phase DESC, w_hierarchical DESC, w_global DESC))::INT AS position FROM ({_tuned(1.0)} UNION ALL {_tuned(0.995)})")
_VARIANTS = " UNION ALL ".join(f"SELECT *, '{n}' AS variant FROM tuned WHERE {' AND '.join(f'w_{m} = 0' for m in E.MODELS if m not in v) or 'true'}" for n, v in E.VARIANTS.items())
query("q_mixture_variants", lambda b: E.variants(E.tune(E.trace(b, CUTOFF, VALIDATION), 0.1)), f"{_TUNED} SELECT * FROM ({_VARIANTS}) QUALIFY row_number() OVER (PARTITION BY variant ORDER BY log_loss, brier, w_phase DESC, w_hierarchical DESC, w_global DESC) = 1")


def _mixture(decay: float, name: str) -> str:
    plain = _trace(VALIDATION, SEASON) if decay == 1.0 else _aged(decay, VALIDATION, SEASON)
    shares = _as([f"R6(m_{p} / {_size([f'm_{q}' for q in PROBS])})" for p in PROBS])
    return f"SELECT '{name}' AS model, actual, {shares} FROM (SELECT actual, {_MIXED} FROM ({plain.replace(STATE_CTE, 'WITH z AS (SELECT 1)', 1)} SELECT * FROM trace) CROSS JOIN ({_tuned(decay)}))"


_BASES = f"SELECT model, actual, {', '.join(PROBS)} FROM ({_trace(VALIDATION, SEASON).replace(STATE_CTE, 'WITH z AS (SELECT 1)', 1)}{_LONG} SELECT * FROM long)"
query("q_eval_report", lambda b: E.report(b, VALIDATION, SEASON), f"{STATE_CTE} SELECT model, {_MEANS} FROM (SELECT *, {_scores(list(PROBS))} FROM ({_BASES} UNION ALL {_mixture(1.0, 'calibrated_mixture')} UNION ALL {_mixture(0.995, 'time_decayed_mixture')})) GROUP BY 1")

# --- trust --------------------------------------------------------------------------------------------------------------
# The second source of these queries: every ten-day span of the seasons is expected, and one season counts six more sixes.
_EXPECTED = f"SELECT season_id, season_id * 100 + slot AS match_id FROM (SELECT unnest(range(1995, 2002))::INT AS season_id) CROSS JOIN (SELECT unnest(range(37))::INT AS slot)"
_REFERENCE = f"SELECT season_id, matches, deliveries, fours, sixes + CASE WHEN season_id = 1997 THEN 6 ELSE 0 END AS sixes, wickets, CASE WHEN season_id = 1998 THEN batter_dots ELSE dots END AS dots FROM ({QUALITY}) WHERE season_id < 2001"


def _expected(balls: DataFrame) -> DataFrame:
    seasons = balls.sparkSession.range(1995, 2002).select(F.col("id").cast("int").alias("season_id"))
    return seasons.select("season_id", F.explode(F.sequence(F.col("season_id") * 100, F.col("season_id") * 100 + 36)).alias("match_id"))


def _reference(balls: DataFrame) -> DataFrame:
    q = A.season_quality(balls).where("season_id < 2001")
    six = F.col("sixes") + F.when(F.col("season_id") == 1997, 6).otherwise(0)
    return q.withColumn("sixes", six).withColumn("dots", F.when(F.col("season_id") == 1998, F.col("batter_dots")).otherwise(F.col("dots"))).drop("batter_dots")


def _covered(balls: DataFrame) -> DataFrame:
    return T.coverage(balls.select("season_id", "match_id"), _expected(balls))


def _reconciled(balls: DataFrame) -> DataFrame:
    q = A.season_quality(balls)
    variants = q.select("season_id", F.lit("dots").alias("metric"), F.lit("batter dots").alias("variant"), F.col("batter_dots").cast("double").alias("value"))
    return T.with_definitions(T.reconciliation(q.drop("batter_dots"), _reference(balls)), variants)


_COVER = f", expected AS ({_EXPECTED}), local AS (SELECT DISTINCT season_id, match_id FROM balls), cover AS (SELECT *, CASE WHEN missing = 0 AND expected > 0 THEN 'complete' ELSE 'incomplete' END AS coverage FROM (SELECT coalesce(e.season_id, l.season_id) AS season_id, count(e.match_id) AS expected, count(l.match_id) AS local, count(*) FILTER (l.match_id IS NULL) AS missing, count(*) FILTER (e.match_id IS NULL) AS unexpected FROM expected e FULL JOIN local l ON e.match_id = l.match_id GROUP BY 1))"
_LONGQ = lambda src, v: " UNION ALL ".join(f"SELECT season_id, '{m}' AS metric, {m}::DOUBLE AS {v} FROM {src}" for m in T.METRICS)
_RECON = f""", quality AS ({QUALITY}), reference AS ({_REFERENCE}), plain AS (SELECT *, local_value - reference_value AS delta, CASE WHEN reference_value <> 0 THEN (local_value - reference_value) / reference_value END AS relative
  FROM ({_LONGQ('quality', 'local_value')}) FULL JOIN ({_LONGQ('reference', 'reference_value')}) USING (season_id, metric)),
recon AS (SELECT p.*, CASE WHEN abs(delta) > 1e-9 AND metric = 'dots' AND abs(batter_dots - reference_value) <= 1e-9 THEN 'batter dots' END AS note,
  CASE WHEN delta IS NULL THEN 'UNAVAILABLE' WHEN abs(delta) <= 1e-9 THEN 'PASS' WHEN metric = 'dots' AND abs(batter_dots - reference_value) <= 1e-9 THEN 'PASS_WITH_DEFINITION_NOTE' ELSE 'FAIL' END AS status
  FROM plain p LEFT JOIN (SELECT season_id, batter_dots FROM quality) USING (season_id))"""
_GATE = ", tally AS (SELECT season_id, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'PASS_WITH_DEFINITION_NOTE') AS noted, count(*) FILTER (status = 'UNAVAILABLE') AS unavailable, count(*) FILTER (status = 'PASS') AS passed FROM recon GROUP BY 1)"
query("q_coverage", _covered, f"{_COVER} SELECT * FROM cover")
query("q_reconciliation", _reconciled, f"{_RECON} SELECT * FROM recon")
query("q_trust_gate", lambda b: T.trust_gate(_covered(b), _reconciled(b)), f"{_COVER}{_RECON}{_GATE} SELECT season_id, CASE WHEN coverage <> 'complete' THEN 'BLOCKED_COVERAGE' WHEN failed > 0 THEN 'BLOCKED_RECONCILIATION' WHEN noted > 0 THEN 'PASS_WITH_DEFINITION_NOTE' WHEN passed = 0 THEN 'UNAVAILABLE' ELSE 'PASS' END AS gate, failed, noted, unavailable, passed FROM cover JOIN tally USING (season_id)")
query("q_trust_dimensions", lambda b: T.trust_dimensions(_covered(b), _reconciled(b), A.malformed(b)), f"{_COVER}{_RECON}{_GATE} SELECT season_id, CASE WHEN coverage = 'complete' THEN 'verified' ELSE 'provisional' END AS source, CASE WHEN failed = 0 THEN 'verified' ELSE 'provisional' END AS external, 'verified' AS internal, CASE WHEN coverage = 'complete' AND failed = 0 THEN 'verified' ELSE 'provisional' END AS overall FROM cover JOIN tally USING (season_id)")
query("q_cross_layer_equality", lambda b: T.cross_layer(A.season_quality(b), _reference(b)), f"{_RECON} SELECT season_id, (count(*) FILTER (local_value IS DISTINCT FROM reference_value) = 0)::INT AS equal FROM recon GROUP BY 1")
