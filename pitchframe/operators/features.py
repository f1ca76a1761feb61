"""Feature families, the snapshot and ledger of what a prediction saw, and evaluation of the contextual models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import FEATURE_STRENGTH, LABELS, PROBS, VENUE_TIER, phase_legal, ratio, tier, top_label
from ..sources.adapter import Dealt
from . import evaluate, state
from .evidence import CHRONOLOGY, recent_form
from .models import BLEND, CANDIDATES, blended, candidate_blends, component, contextual, counts, feature_frame, named, normalised, rounded, size, spread

# Families made of a history: the histories blended in equal parts, a sample that earns the full weight, and that weight.
HISTORY_FAMILIES = {
    "A": ("batter",), "B": ("bowler",), "C": ("batter_bowler",), "D": ("batter_bowler_type",), "E": ("bowler_batter_type",),
    "F": ("phase",), "G": ("venue",), "H": ("team_batting",), "I": ("team_bowling",), "J": ("team_batting", "team_bowling"),
    "T": ("venue",), "U": ("team_batting", "team_bowling"), "W": ("similar",),
}
FULL_SAMPLE, FULL_WEIGHT = 250.0, 0.35

# Families of the state of play: when they are available, and the factors on labels under each condition.
STATE_FAMILIES = {
    "K": ("true", (("score_before * 6 >= 9 * greatest(legal_before, 1)", {"4": 1.06, "6": 1.06}),
                   ("score_before * 6 < 9 * greatest(legal_before, 1)", {"0": 1.04, "1": 1.03}))),
    "L": ("true", (("legal_before > 0 AND score_before * 6 >= 9 * legal_before", {"4": 1.05, "6": 1.05}),
                   ("legal_before = 0 OR score_before * 6 < 9 * legal_before", {"0": 1.04, "1": 1.03}))),
    "M": ("required_rate IS NOT NULL", (("gap >= 2", {"4": 1.10, "6": 1.10, "wicket": 1.05, "0": 0.93}), ("gap <= -1.5", {"0": 1.05, "1": 1.04, "6": 0.93}))),
    "N": ("true", (("wickets_before BETWEEN 7 AND 9", {"wicket": 1.08, "6": 0.95}),)),
    "O": ("true", (("legal_before BETWEEN 96 AND 119", {"4": 1.06, "6": 1.07, "wicket": 1.04}),)),
    "P": ("recent_total > 0", (("recent_4 + recent_6 >= 2", {"4": 1.05, "6": 1.05}), ("recent_wicket >= 1", {"wicket": 1.06}))),
    "Q": ("striker_balls >= 6", (("striker_rate >= 150", {"4": 1.08, "6": 1.10}), ("striker_rate <= 90", {"0": 1.05, "wicket": 1.04}))),
    "R": ("spell_balls >= 6", (("spell_economy >= 10", {"4": 1.06, "6": 1.05}), ("spell_economy <= 6", {"0": 1.06, "wicket": 1.05}))),
    "S": ("bat_balls >= 30 OR bowl_balls >= 24", (("bat_balls >= 30 AND bat_rate >= 145", {"4": 1.04, "6": 1.05}),
                                                  ("bowl_balls >= 24 AND bowl_economy <= 7", {"0": 1.04, "wicket": 1.03}))),
    "V": ("partnership_balls >= 12", (("partnership_rate >= 150", {"1": 1.05, "4": 1.06}),)),
    "X": ("true", (("window_legal >= 6 AND window_rate <= 5", {"0": 1.05, "wicket": 1.03}), ("window_legal >= 6 AND window_rate >= 10", {"4": 1.06, "6": 1.05}),
                   ("legal_before >= 90", {"4": 1.02, "6": 1.03}))),
    "Y": ("false", ()),  # the toss is not known ball by ball
}
#: Family Z: the season so far, 0.3 beside 0.7 of the base.
SEASON_WEIGHT = 0.3

# What a ledger lists: feature, value or distribution, source, influence.
LEDGER = (
    ("current_score", "score_before", "match_state", "state_input"), ("wickets_before", "wickets_before", "match_state", "state_input"),
    ("current_run_rate", "current_rate", "derived_match_state", "tempo_signal"), ("required_run_rate", "required_rate", "derived_match_state", "pressure_signal"),
    ("pressure_gap", "gap", "derived_match_state", "pressure_signal"), ("batter_history_distribution", "batter", "deliveries", "blend_component"),
    ("bowler_history_distribution", "bowler", "deliveries", "blend_component"), ("batter_bowler_matchup_distribution", "batter_bowler", "deliveries", "blend_component"),
    ("similar_situations_distribution", "similar", "deliveries", "blend_component"), ("venue_distribution", "venue", "match_metadata+deliveries", "venue"),
)

#: Fields of a snapshot whose changes are reported.
TRACKED = (
    "score_before", "wickets_before", "legal_before", "current_rate", "required_rate", "gap", "runs_required", "balls_remaining",
    "wickets_remaining", "striker_runs", "striker_balls", "spell_conceded", "spell_balls", "partnership_runs", "partnership_balls",
    "window_runs", "window_wickets", "venue_sample", "matchup_sample", "similar_sample",
)


def family_frame(balls: DataFrame | Dealt, season: int) -> DataFrame:
    """The balls of ``season`` with everything that families read: histories, state of play, and the players' last five matches."""
    rows = feature_frame(balls, season)
    for role, prefix in (("batter", "bat"), ("bowler", "bowl")):
        form = recent_form(balls.plain if isinstance(balls, Dealt) else balls, role).where(F.col("season_id") == season)
        rate = ("bat_rate", 100) if role == "batter" else ("bowl_economy", 6)
        form = form.select(
            F.col("player").alias(role), "season_id", "match_id", F.col("form_balls").alias(f"{prefix}_balls"), ratio("form_runs", "form_balls", rate[1]).alias(rate[0])
        )
        rows = rows.join(form, [role, "season_id", "match_id"])
    return rows.withColumn("recent_total", size(counts("recent")))


def families(frame: DataFrame, *names: str) -> DataFrame:
    """By ball and family (all, or ``names``): whether it is available, its sample, and the base's probabilities as the family changes them."""
    wanted = lambda of: {n: x for n, x in of.items() if not names or n in names}
    base = [F.col(f"hier_{p}") for p in PROBS]
    used = dict.fromkeys(n for parts in wanted(HISTORY_FAMILIES).values() for n in parts)
    rows = frame.withColumns({f"s_{n}_{p}": v for n in used for p, v in zip(PROBS, component(n), strict=True)})
    rows = rows.withColumns({f"of_{n}": size(counts(n)) for n in (*used, "season")})
    rows = rows.withColumns({f"ok_{k}": F.expr(condition) for k, (condition, _) in wanted(STATE_FAMILIES).items()})

    def entry(name: str, available: Column, sample: Column, probs: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("family"), available.cast("int").alias("available"), sample.cast("bigint").alias("sample"), *named(probs))

    entries = []
    for name, parts in wanted(HISTORY_FAMILIES).items():
        n = F.least(*(F.col(f"of_{x}") for x in parts)) if len(parts) > 1 else F.col(f"of_{parts[0]}")
        w = F.least(F.lit(FULL_WEIGHT), n * FULL_WEIGHT / FULL_SAMPLE)
        source = [size([F.col(f"s_{x}_{p}") for x in parts]) / float(len(parts)) for p in PROBS]
        entries.append(entry(name, n > 0, n, [b * (1.0 - w) + s * w for b, s in zip(base, source, strict=True)]))
    for name, (_, factors) in wanted(STATE_FAMILIES).items():
        ok, probs = F.col(f"ok_{name}"), dict(zip(LABELS, base, strict=True))
        for condition, change in factors:
            for label, factor in change.items():
                probs[label] = probs[label] * F.when(ok & F.expr(condition), factor).otherwise(1.0)
        entries.append(entry(name, ok, ok.cast("int"), list(probs.values())))
    n = F.col("of_season")
    season = [F.when(n > 0, b * (1.0 - SEASON_WEIGHT) + c / n * SEASON_WEIGHT).otherwise(b) for b, c in zip(base, counts("season"), strict=True)]
    if not names or "Z" in names:
        entries.append(entry("Z", n > 0, (n > 0).cast("int"), season))
    rows = spread(rows.select(*CHRONOLOGY, "legal_phase", "label", F.array(*entries).alias("f")), "f")
    shares = [rounded(v) for v in normalised([F.col(p) for p in PROBS])]
    return rows.select(*CHRONOLOGY, "legal_phase", F.col("label").alias("actual"), "family", "available", "sample", *named(shares))


def family_coverage(rows: DataFrame) -> DataFrame:
    """By family: scores of its predictions, how many of them it was available for, and their share."""
    scores = evaluate.scored([F.col(p) for p in PROBS])
    got = rows.withColumns(scores).groupBy("family")
    got = got.agg(F.count("*").alias("samples"), F.sum("available").cast("bigint").alias("available"), *(rounded(F.avg(k)).alias(k) for k in scores))
    return got.withColumn("coverage", rounded(F.col("available") / F.col("samples")))


def evaluated_candidates(frame: DataFrame) -> DataFrame:
    """By ball and candidate: probabilities of the named blends and of the whole contextual model, ``combined_context``."""
    whole = contextual(frame)
    rows = candidate_blends(whole, "legal_phase", combined_context=[F.col(f"c_{p}") for p in PROBS])
    return rows.withColumnRenamed("label", "actual")


def evaluate_parts() -> dict[str, tuple[tuple[str, float], ...]]:
    """The named blends and their weights."""
    return CANDIDATES


def pressure(gap: Column) -> Column:
    return F.when(gap >= 2, "high").when(gap <= -1.5, "low").otherwise("balanced")


def by_pressure(frame: DataFrame) -> DataFrame:
    """Scores of the contextual model by the pressure of the chase."""
    probs = [F.col(f"c_{p}") for p in PROBS]
    rows = contextual(frame).select(F.col("label").alias("actual"), pressure(F.col("gap")).alias("pressure"), *named(probs))
    return evaluate.metrics(rows, "pressure")


def snapshot(frame: DataFrame) -> DataFrame:
    """What a prediction of each ball sees, in one row."""
    chasing = F.col("target").isNotNull() & (F.col("innings") == 2)
    runs = F.when(chasing, F.greatest(F.col("target") - F.col("score_before"), F.lit(0)))
    return frame.select(
        *CHRONOLOGY, phase_legal().alias("phase"), "score_before", "wickets_before", "legal_before", "current_rate", "required_rate", "gap",
        runs.alias("runs_required"), F.greatest(F.lit(120) - F.col("legal_before"), F.lit(0)).alias("balls_remaining"),
        F.greatest(F.lit(10) - F.col("wickets_before"), F.lit(0)).alias("wickets_remaining"), "striker_runs", "striker_balls", "spell_conceded", "spell_balls",
        "partnership_runs", "partnership_balls", "window_runs", "window_wickets", "team_batting", "team_bowling", "venue",
        size(counts("venue")).alias("venue_sample"), size(counts("batter_bowler")).alias("matchup_sample"), size(counts("similar")).alias("similar_sample"), "recent",
    )


def snapshot_difference(rows: DataFrame) -> DataFrame:
    """Which tracked fields and whether the recent outcomes changed since the ball before in the innings."""
    w = Window.partitionBy(*state.INNINGS).orderBy(*state.BALL)
    fields = (*TRACKED, "recent")
    changed = [F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("int")).alias(f"{c}_changed") for c in fields]
    out = rows.select(*CHRONOLOGY, *changed)
    return out.withColumn("n_changed", sum((F.col(f"{c}_changed") for c in fields[1:]), F.col(f"{fields[0]}_changed")).cast("int"))


def ledger(frame: DataFrame) -> DataFrame:
    """Ten rows for each ball: a feature, its value or distribution, where it is from, its sample, strength and influence."""
    entries = []
    for feature, source, origin, influence in LEDGER:
        held = source in ("batter", "bowler", "batter_bowler", "similar", "venue")
        n = size(counts(source)) if held else F.lit(1)
        value = F.lit(None).cast("double") if held else F.col(source).cast("double")
        probs = [rounded(v) for v in component(source)] if held else [F.lit(None).cast("double")] * len(PROBS)
        shown = F.concat(F.lit("venue_"), tier(n, *VENUE_TIER)) if influence == "venue" else F.lit(influence)
        entries.append(
            F.struct(
                F.lit(feature).alias("feature"), value.alias("value"), *named(probs), F.lit(origin).alias("source"),
                n.cast("bigint").alias("sample_size"), tier(n, *FEATURE_STRENGTH).alias("strength"), shown.alias("influence"),
            )
        )
    return spread(frame.select(*CHRONOLOGY, F.array(*entries).alias("e")), "e")


def evidence_strength(frame: DataFrame) -> DataFrame:
    """The label of how much a prediction rests on, from its sample, its reliability, the match-up and comparable balls."""
    rows = contextual(frame)
    matchup, comparable, sample = size(counts("batter_bowler")), size(counts("similar")), F.col("evidence_sample")
    reliable = tier("evidence_sample", [(180, "high"), (60, "medium"), (20, "low")], "very_low")
    limited = (sample < 40) | (matchup == 0) | (comparable == 0) | (reliable == "low")
    label = F.when(limited, "LIMITED EVIDENCE").when((sample < 120) | (reliable == "medium"), "MODERATE SIGNAL").otherwise("STRONG SIGNAL")
    return rows.select(*CHRONOLOGY, sample.alias("evidence_sample"), matchup.alias("matchup"), comparable.alias("comparable"), label.alias("strength"))


def model_selection(experiments: DataFrame) -> DataFrame:
    """Models ranked over experiments (model, log_loss, brier, top1): means, then how far apart the experiments are."""
    got = experiments.groupBy("model").agg(
        F.count("*").alias("windows"), *(rounded(F.avg(k)).alias(f"mean_{k}") for k in ("log_loss", "brier", "top1")),
        *(rounded(F.max(k) - F.min(k)).alias(f"range_{k}") for k in ("log_loss", "brier")),
    )
    order = Window.orderBy("mean_log_loss", "mean_brier", "range_log_loss", "range_brier", F.desc("mean_top1"), "model")  # a row for each model
    return got.withColumn("position", F.row_number().over(order))


def situation_buckets(balls: DataFrame) -> DataFrame:
    """Balls, runs and wickets by wickets lost before (0-2, 3-5, 6+) and window of three overs."""
    low = (F.floor(F.col("legal_before") / 18) * 3).cast("int")
    wickets = F.when(F.col("wickets_before") <= 2, "0-2").when(F.col("wickets_before") <= 5, "3-5").otherwise("6+")
    window = F.concat(low.cast("string"), F.lit("-"), (low + 2).cast("string"))
    rows = state.with_state(balls).select(wickets.alias("wickets_lost"), window.alias("overs"), "total_runs", "is_wicket")
    return rows.groupBy("wickets_lost", "overs").agg(F.count("*").alias("n"), F.sum("total_runs").cast("bigint").alias("runs"), F.sum("is_wicket").cast("bigint").alias("wickets"))


def final_states(balls: DataFrame) -> DataFrame:
    """The score, wickets and legal balls of each innings after its last ball."""
    w = Window.partitionBy(*state.INNINGS).orderBy(*(F.desc(c) for c in state.BALL))
    rows = state.with_state(balls).withColumn("back", F.row_number().over(w)).where("back = 1")
    after = {"score": F.col("score_before") + F.col("total_runs"), "wickets": F.col("wickets_before") + F.col("is_wicket"), "legal_balls": F.col("legal_before") + F.col("legal_ball")}
    return rows.select(*state.INNINGS, "over_number", "ball_number", *(v.cast("bigint").alias(k) for k, v in after.items()))


def result_margins(balls: DataFrame) -> DataFrame:
    """By match: how it was won (runs, if the first side had more; wickets in hand otherwise), by how many, and as text."""
    first, second = (F.col("innings") == n for n in (1, 2))
    rows = balls.groupBy("season_id", "match_id").agg(
        F.max(F.when(first, F.col("team_batting"))).alias("team_a"), F.max(F.when(second, F.col("team_batting"))).alias("team_b"),
        F.sum(F.when(first, F.col("total_runs"))).alias("a"), F.sum(F.when(second, F.col("total_runs"))).alias("b"),
        F.sum(F.when(second, F.col("is_wicket"))).alias("lost"),
    )
    kind = F.when(F.col("a") > F.col("b"), "runs").when(F.col("b") > F.col("a"), "wickets")
    margin = F.when(kind == "runs", F.col("a") - F.col("b")).when(kind == "wickets", F.greatest(F.lit(10) - F.col("lost"), F.lit(0)))
    winner = F.when(kind == "runs", F.col("team_a")).when(kind == "wickets", F.col("team_b"))
    rows = rows.select("season_id", "match_id", winner.alias("winner"), kind.alias("result_type"), margin.cast("bigint").alias("margin"))
    return rows.withColumn("summary", F.when(F.col("winner").isNotNull(), F.concat_ws(" ", "winner", F.lit("won by"), F.col("margin").cast("string"), "result_type")))


def best_phase(balls: DataFrame) -> DataFrame:
    """By batter: the phase of the highest strike rate, with runs and balls; the earlier phase where equal."""
    rank = F.when(F.col("phase") == "powerplay", 1).when(F.col("phase") == "middle", 2).otherwise(3)
    rows = state.with_state(balls).withColumn("phase", phase_legal()).groupBy("batter", "phase")
    rows = rows.agg(F.sum("batter_runs").cast("bigint").alias("runs"), F.sum(1 - F.col("is_wide_ball")).cast("bigint").alias("balls"))
    rows = rows.withColumn("strike_rate", ratio("runs", "balls", 100))
    w = Window.partitionBy("batter").orderBy(F.desc("strike_rate"), rank)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def longest_innings(balls: DataFrame) -> DataFrame:
    """The innings of most balls; the earliest where equal."""
    return balls.groupBy(*state.INNINGS).agg(F.count("*").alias("deliveries")).orderBy(F.desc("deliveries"), *state.INNINGS).limit(1)


def venue_matches(balls: DataFrame, meta: DataFrame, venue: str) -> DataFrame:
    """Outcome totals of the balls of matches at ``venue``: a semi-join on the match record."""
    at = meta.where(F.col("venue") == venue).select("season_id", "match_id")
    rows = balls.join(at, ["season_id", "match_id"], "left_semi")
    return rows.groupBy("season_id").agg(F.count("*").alias("deliveries"), F.sum("total_runs").cast("bigint").alias("runs"), F.sum("is_wicket").cast("bigint").alias("wickets"))


def frame_of(balls: DataFrame | Dealt, season: int) -> DataFrame:
    return feature_frame(balls, season)


def trace_join(plain: DataFrame, aged: DataFrame) -> DataFrame:
    """By phase of the innings: balls that both traces hold, and the mean change of the hierarchical model's chance of what came."""
    keys = list(CHRONOLOGY)
    own = [F.col(f"hierarchical_{p}") for p in PROBS]
    a = plain.select(*keys, "legal_phase", evaluate.of_actual(own).alias("before"))
    b = aged.select(*keys, evaluate.of_actual(own).alias("after"))
    return a.join(b, keys).groupBy("legal_phase").agg(F.count("*").alias("n"), rounded(F.avg(F.col("after") - F.col("before"))).alias("change"))


def innings_with(balls: DataFrame, batter: str) -> DataFrame:
    """Runs and balls of the whole side by phase, in the innings in which ``batter`` batted: a semi-join, then the state of those innings."""
    own = balls.where(F.col("batter") == batter).select(*state.INNINGS).distinct()
    rows = state.with_state(balls.join(own, list(state.INNINGS), "left_semi")).withColumn("phase", phase_legal())
    return rows.groupBy("season_id", "phase").agg(F.count("*").alias("n"), F.sum("total_runs").cast("bigint").alias("runs"), F.sum("is_wicket").cast("bigint").alias("wickets"))


def phases_in_order(balls: DataFrame, season: int) -> DataFrame:
    """A season's phases in the order of play, with their place in it."""
    place = F.when(F.col("phase") == "powerplay", 1).when(F.col("phase") == "middle", 2).otherwise(3)
    rows = state.with_state(balls.where(F.col("season_id") == season)).withColumn("phase", phase_legal())
    rows = rows.groupBy("phase").agg(F.count("*").alias("n"), F.sum("total_runs").cast("bigint").alias("runs"))
    return rows.select(place.alias("place"), "phase", "n", "runs").orderBy("place")


def first_match(meta: DataFrame, team: str) -> DataFrame:
    """The record of a team's earliest match."""
    return meta.where((F.col("team_a") == team) | (F.col("team_b") == team)).orderBy("match_date", "match_id").limit(1)


def without_matches(balls: DataFrame, dropped: list[int]) -> DataFrame:
    """Seasons' balls after the matches named are taken away: an anti-join on the match."""
    gone = balls.sparkSession.createDataFrame([(m,) for m in dropped], "match_id int")
    return balls.join(F.broadcast(gone), "match_id", "left_anti").groupBy("season_id").agg(F.count("*").alias("deliveries"))  # as many rows as are named


def with_residue(values: list[Column]) -> list[Column]:
    """Shares to six places that add up to one: what rounding leaves goes to the largest, the first in label order where equal."""
    shares = [rounded(v) for v in values]
    rest = rounded(F.lit(1.0) - size(shares))
    top = top_label(shares)
    return [s + F.when(top == label, rest).otherwise(0.0) for s, label in zip(shares, LABELS, strict=True)]


def blend_contributions(frame: DataFrame) -> DataFrame:
    """By ball and component of the contextual blend: its share of the weights; components without weight are left out."""
    rows = blended(frame)
    parts = [F.struct(F.lit(n).alias("component"), rounded(F.col(f"w_{n}") / F.col("w_total")).alias("share")) for n, _, _ in BLEND]
    return spread(rows.select(*CHRONOLOGY, F.array(*parts).alias("c")), "c").where("share > 0")


def exact_blend(frame: DataFrame) -> DataFrame:
    """The contextual blend as shares to six places that add up to one, with its most likely label."""
    probs = with_residue([F.col(f"b_{p}") for p in PROBS])
    rows = blended(frame).select(*CHRONOLOGY, *named(probs))
    return rows.withColumn("top", top_label([F.col(p) for p in PROBS]))
