"""Next-ball models: distributions over the seven outcomes from histories, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import COUNTS, HIERARCHY_TIER, LABELS, PROBS, phase_legal, smoothed, tier, top_label
from ..sources.adapter import Dealt
from . import state
from .evidence import CHRONOLOGY, SIMILAR_KEYS, histories, labelled, over_totals, plainly, read, windowed, with_similar

# The levels of the back-off with the samples that are enough, strictest first.
BACKOFF = (("batter_bowler", 25), ("batter_bowler_type", 35), ("bowler_batter_type", 35), ("types", 100))

# Components of the contextual blend, their largest weight, and the sample that earns it.
BLEND = (
    ("hierarchical", 0.28, None), ("global", 0.10, None), ("phase", 0.14, 8000), ("batter", 0.18, 1600),
    ("bowler", 0.16, 1600), ("batter_bowler", 0.20, 140), ("batter_bowler_type", 0.10, 220),
    ("bowler_batter_type", 0.09, 220), ("team_batting", 0.08, 4000), ("team_bowling", 0.08, 4000), ("venue", 0.07, 2400),
    ("similar", 0.14, 2000), ("recent", 0.08, 6),
)

# The named candidate blends, component weights in order.
CANDIDATES = {
    "baseline": (("hierarchical", 1.0),),
    "innings_state_context": (("hierarchical", 0.82), ("phase", 0.18)),
    "player_history_context": (("hierarchical", 0.40), ("batter", 0.35), ("bowler", 0.25)),
    "bowler_history_context": (("hierarchical", 0.45), ("bowler", 0.35), ("bowler_batter_type", 0.20)),
    "matchup_context": (("hierarchical", 0.35), ("batter_bowler", 0.35), ("similar", 0.20), ("recent", 0.10)),
    "team_opposition_context": (("hierarchical", 0.65), ("team_batting", 0.20), ("team_bowling", 0.15)),
    "venue_context": (("hierarchical", 0.75), ("venue", 0.25)),
    "recent_context": (("hierarchical", 0.75), ("recent", 0.25)),
    "similar_situations_context": (("hierarchical", 0.70), ("similar", 0.30)),
}


def counts(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{c}") for c in COUNTS]


def size(values: list[Column]) -> Column:
    return sum(values[1:], values[0])


def normalised(values: list[Column]) -> list[Column]:
    """Shares of the sum; equal shares where it is not positive."""
    n = size(values)
    return [F.when(n > 0, v / n).otherwise(1.0 / len(LABELS)) for v in values]


def named(values: list[Column], prefix: str = "") -> list[Column]:
    return [v.alias(prefix + p) for v, p in zip(values, PROBS, strict=True)]


def rounded(value: Column, digits: int = 6) -> Column:
    """Half up, by the same arithmetic in any engine."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def spread(rows: DataFrame, entries: str) -> DataFrame:
    """``rows`` with a row for each of the structs of ``entries``, an array never empty, and their fields. The array is a column of a projection, which
    Spark compiles: as the argument of a generator on wide rows it would be interpreted node by node, as the condition that ``explode`` infers would
    repeat it."""
    kept = [c for c in rows.columns if c != entries]
    return rows.select(*kept, F.explode_outer(entries).alias(entries)).select(*kept, f"{entries}.*")


def hierarchical(rows: DataFrame) -> DataFrame:
    """``rows`` with the first level of BACKOFF that has enough balls, its size, reliability and ``hier_*`` probabilities."""
    level = n = None
    chosen: list[Column] = []
    for name, least in BACKOFF:
        enough = size(counts(name)) >= least
        level = F.when(enough, name) if level is None else level.when(enough, name)
        n = F.when(enough, size(counts(name))) if n is None else n.when(enough, size(counts(name)))
        chosen = [F.when(enough, c) for c in counts(name)] if not chosen else [x.when(enough, c) for x, c in zip(chosen, counts(name), strict=True)]
    rows = rows.withColumns({"level": level.otherwise("global"), "sample": n.otherwise(size(counts("global")))})
    rows = rows.withColumns({f"chosen_{c}": x.otherwise(g) for c, x, g in zip(COUNTS, chosen, counts("global"), strict=True)})
    rows = rows.withColumns({f"hier_{p}": v for p, v in zip(PROBS, smoothed(counts("chosen")), strict=True)})
    return rows.withColumn("reliability", tier("sample", *HIERARCHY_TIER))


def baseline(balls: DataFrame, context: str, plain: DataFrame | None = None) -> DataFrame:
    """Smoothed probabilities from one context; from the whole history where the context has none. ``plain``: the same balls, uncut."""
    contexts = tuple(dict.fromkeys((context, "global")))
    rows = histories(read(labelled(balls), context), *contexts, balls=plainly(plain, *contexts))
    used = [F.when(size(counts(context)) > 0, c).otherwise(g) for c, g in zip(counts(context), counts("global"), strict=True)]
    probs = smoothed(used)
    return rows.select(*CHRONOLOGY, *named(probs), top_label(probs).alias("top"), F.col("label").alias("actual"))


def model_hierarchical(balls: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """The hierarchical prediction of every ball. ``plain``: the same balls, uncut."""
    contexts = (*(n for n, _ in BACKOFF), "global")
    rows = hierarchical(histories(read(labelled(balls), *contexts), *contexts, balls=plainly(plain, *contexts)))
    probs = [F.col(f"hier_{p}") for p in PROBS]
    return rows.select(
        *CHRONOLOGY, "level", "sample", "reliability", *named(probs), top_label(probs).alias("top"), F.col("label").alias("actual")
    )


def feature_frame(balls: DataFrame | Dealt, season: int | None = None) -> DataFrame:
    """Every history and state that the models read, for every ball, or every ball of ``season``.

    Balls are exchanged by innings once, before anything is made of them; where they are ``Dealt``, they stay there for the pass, and only
    the totals of earlier innings go through further exchanges. The state of play and the histories come from one pass over each innings.
    """
    contexts = ("batter", "bowler", "batter_bowler", "batter_bowler_type", "bowler_batter_type", "types", "phase",
                "team_batting", "team_bowling", "venue", "season", "legal_phase", "global")
    balls, _, sides, tasks = balls if isinstance(balls, Dealt) else (balls, balls, balls, None)
    base = windowed(labelled(balls))
    earlier = base if season is None else base.where(F.col("season_id") <= season)
    rows = read(state.with_played(base), *contexts, more=("over_window", "asked_window", *state.PLAYED))
    rows = histories(rows, *contexts, *SIMILAR_KEYS, season=season, balls=base, inside=state.with_recent, sums=state.PLAY, overs=over_totals(earlier, season), tasks=tasks)
    rows = with_similar(hierarchical(state.with_rates(rows, sides)))
    return rows.withColumns({f"recent_{c}": F.col(f"recent_{x.replace('+', 'p')}") for x, c in zip(LABELS, COUNTS, strict=True)})


def component(name: str) -> list[Column]:
    return [F.col(f"hier_{p}") for p in PROBS] if name == "hierarchical" else smoothed(counts(name))


def blended(rows: DataFrame) -> DataFrame:
    """``rows`` with the contextual blend, ``b_*``. Each step is a projection of its own: Catalyst then evaluates a value
    that the next step uses several times once, where nested expressions would repeat it."""
    rows = rows.withColumns({f"of_{n}": size(counts(n)) for n, _, enough in BLEND if enough is not None})
    weights = {
        f"w_{n}": F.lit(cap) if enough is None else F.least(F.lit(cap), F.col(f"of_{n}") * cap / F.lit(float(enough))) for n, cap, enough in BLEND
    }
    rows = rows.withColumns(weights).withColumn("w_total", size([F.col(w) for w in weights]))
    parts = [(F.col(f"w_{n}"), component(n)) for n, _, _ in BLEND]
    rows = rows.withColumns({f"x_{p}": size([w / F.col("w_total") * v[i] for w, v in parts]) for i, p in enumerate(PROBS)})
    return rows.withColumns(dict(zip((f"b_{p}" for p in PROBS), normalised([F.col(f"x_{p}") for p in PROBS]), strict=True)))


def multipliers() -> list[tuple[Column, dict[str, float]]]:
    """Conditions on the state of play and the factors they put on labels; all that hold apply."""
    # The conditions' limits and the factors.
    col, fours = F.col, F.col("recent_4") + F.col("recent_6")
    striker, spell = col("striker_balls") >= 6, col("spell_balls") >= 6
    pair, window = col("partnership_balls") >= 12, col("window_legal") >= 6
    venue, match = size(counts("venue")), size(counts("batter_bowler"))
    return [
        (col("gap") >= 2.0, {"4": 1.12, "6": 1.10, "wicket": 1.08, "0": 0.92}),
        (col("gap") <= -1.5, {"0": 1.06, "1": 1.08, "4": 0.95, "6": 0.90}),
        (10 - col("wickets_before") <= 3, {"wicket": 1.08, "0": 1.04, "6": 0.95}),
        (striker & (col("striker_rate") >= 150), {"4": 1.08, "6": 1.10}),
        (striker & (col("striker_rate") <= 90), {"0": 1.05, "1": 1.04, "wicket": 1.04}),
        (spell & (col("spell_economy") >= 10), {"4": 1.07, "6": 1.06}),
        (spell & (col("spell_economy") <= 6), {"0": 1.06, "wicket": 1.05}),
        (fours >= 2, {"4": 1.05, "6": 1.05}),
        (col("recent_wicket") >= 1, {"wicket": 1.06}),
        (pair & (col("partnership_rate") >= 150), {"1": 1.05, "4": 1.06}),
        (window & (col("window_rate") <= 5), {"0": 1.05, "wicket": 1.03}),
        (window & (col("window_rate") >= 10), {"4": 1.06, "6": 1.05}),
        ((venue >= 600) & (smoothed(counts("venue"))[5] >= 0.03), {"6": 1.03}),
        ((match >= 20) & (smoothed(counts("batter_bowler"))[6] >= 0.1), {"wicket": 1.08}),
    ]


def adjusted(rows: DataFrame, source: str, factors: list[tuple[Column, dict[str, float]]], to: str) -> DataFrame:
    """``rows`` with the probabilities ``source``_* times the factors whose conditions hold, as shares, ``to``_*."""
    out = {p: F.col(f"{source}_{p}") for p in PROBS}
    for condition, change in factors:
        for label, factor in change.items():
            p = PROBS[LABELS.index(label)]
            out[p] = out[p] * F.when(condition, factor).otherwise(1.0)
    rows = rows.withColumns({f"y_{p}": v for p, v in out.items()})
    return rows.withColumns(dict(zip((f"{to}_{p}" for p in PROBS), normalised([F.col(f"y_{p}") for p in PROBS]), strict=True)))


def contextual(frame: DataFrame) -> DataFrame:
    """The blend, adjusted for the state of play, with its evidence."""
    rows = adjusted(blended(frame), "b", multipliers(), "c")
    evidence = size(counts("batter_bowler")) + size(counts("similar"))
    for name in ("batter", "bowler"):
        evidence = evidence + F.least(size(counts(name)), F.lit(400))
    return rows.withColumn("evidence_sample", (evidence + size(counts("recent"))).cast("bigint"))


def model_contextual(balls: DataFrame | Dealt) -> DataFrame:
    rows = contextual(feature_frame(balls))
    probs = [rounded(F.col(f"c_{p}")) for p in PROBS]
    return rows.select(*CHRONOLOGY, *named(probs), "evidence_sample", F.col("label").alias("actual"))


def candidate_blends(frame: DataFrame, *keep: str, **known: list[Column]) -> DataFrame:
    """The named candidate blends of every ball, one row for each, with the columns ``keep``; and the probabilities ``known`` by name as they are."""
    used = dict.fromkeys(n for parts in CANDIDATES.values() for n, _ in parts)
    rows = frame.withColumns({f"s_{n}_{p}": v for n in used for p, v in zip(PROBS, component(n), strict=True)})
    mixed = []
    for name, parts in CANDIDATES.items():
        whole = size([F.lit(w) for _, w in parts])
        probs = (size([F.lit(w) / whole * F.col(f"s_{n}_{p}") for n, w in parts]).alias(p) for p in PROBS)
        mixed.append(F.struct(F.lit(name).alias("candidate"), *probs))
    mixed += [F.struct(F.lit(name).alias("candidate"), *named(probs)) for name, probs in known.items()]
    kept = [*CHRONOLOGY, "label", *keep]
    rows = spread(rows.select(*kept, F.array(*mixed).alias("r")), "r")
    whole = [F.col(p) for p in PROBS]
    shares = [F.when(F.col("candidate").isin(*known), p).otherwise(v) if known else v for p, v in zip(whole, normalised(whole), strict=True)]
    return rows.select(*kept, "candidate", *named([rounded(v) for v in shares]))


def prediction_difference(balls: DataFrame) -> DataFrame:
    """How a few tracked fields of the state changed since the ball before in the innings."""
    from pyspark.sql import Window

    w = Window.partitionBy(*state.INNINGS).orderBy(*state.BALL)
    rows = state.with_state(balls).withColumn("phase", phase_legal())
    changes = {f"{c}_changed": F.coalesce((~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("int"), F.lit(0)) for c in ("batter", "bowler", "phase", "wickets_before", "score_before")}
    first = F.row_number().over(w) == 1
    changes = {k: F.when(first, 0).otherwise(v) for k, v in changes.items()}
    rows = rows.select(*CHRONOLOGY, *(v.alias(k) for k, v in changes.items()))
    return rows.withColumn("n_changed", sum(F.col(k) for k in changes).cast("int"))
