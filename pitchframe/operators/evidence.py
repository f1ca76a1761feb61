"""Leak-free histories: what was known strictly before each ball, for all balls at once.

A history is an exclusive running sum in chronological order. As a key may have a large share of all balls, sums take innings: totals of
each key and innings are summed over earlier innings (``scan``), and added to the running sum inside the innings (``counting``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import COUNTS, LABELS, conceded, outcome, phase_legal, phase_over, ratio
from . import scan
from .counting import counted as _counted
from .state import BALL, BEFORE, INNINGS, with_state

CHRONOLOGY = (*INNINGS, *BALL)

#: Contexts by player: keys, and whether a null key has a history (it has none: equality with null never holds).
CONTEXTS = {
    "batter": ("batter",),
    "bowler": ("bowler",),
    "batter_bowler": ("batter", "bowler"),
    "batter_bowler_type": ("batter", "bowler_type"),
    "bowler_batter_type": ("bowler", "batsman_type"),
    "types": ("batsman_type", "bowler_type"),
    "phase": ("over_phase",),
    "team_batting": ("team_batting",),
    "team_bowling": ("team_bowling",),
    "season": ("season_id",),
    "legal_phase": ("legal_phase",),
    "venue": ("venue",),
    "global": (),
}


# Keys of similar situations, strictest first, and how many such balls are enough.
SIMILAR = (
    (("batsman_type", "bowler_type", "innings", "team_batting", "team_bowling"), 120),
    (("batsman_type", "bowler_type", "innings"), 220),
    (("batsman_type", "bowler_type"), 1),
)
#: Of each level of SIMILAR, what a ball counts under and what it asks for: the same three overs or, at the last level, the same phase.
#: Overs asked for begin at a multiple of three, so that a ball counts in one such window only.
SIMILAR_KEYS = {
    f"s{i}": tuple((*keys, at) for at in (("over_phase", "legal_phase") if i == 2 else ("over_window", "asked_window"))) for i, (keys, _) in enumerate(SIMILAR)
}


OVERS = ("s0", "s1")  #: levels by overs


def with_venue(balls: DataFrame, matches: DataFrame) -> DataFrame:
    """``balls`` with the venue of their match's record; null where there is none."""
    return balls.join(F.broadcast(matches.select("season_id", "match_id", "venue")), ["season_id", "match_id"], "left")  # a row for each match


def labelled(balls: DataFrame) -> DataFrame:
    """Deliveries with state before, both phases, venue (null if ``balls`` have none), label and its seven indicators."""
    rows = with_state(balls).withColumns({"label": outcome(), "over_phase": phase_over(), "legal_phase": phase_legal()})
    rows = rows if "venue" in balls.columns else rows.withColumn("venue", F.lit(None).cast("string"))
    return rows.withColumns({c: F.when(F.col("label") == x, 1).otherwise(0) for x, c in zip(LABELS, COUNTS, strict=True)})


def read(rows: DataFrame, *contexts: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (``labelled``) with what histories of ``contexts`` need and ``more``: all columns that are kept go through the tasks' batches."""
    return rows.select(*dict.fromkeys((*CHRONOLOGY, *(k for c in contexts for k in CONTEXTS[c]), "label", *more, *COUNTS)))


def plainly(plain: DataFrame | None, *contexts: str) -> DataFrame | None:
    """``plain`` deliveries with what totals of ``contexts`` need, if none of it is made of balls' numbers: their plan then has no exchange by innings."""
    numbered = {"over_phase", "legal_phase"} & {k for c in contexts for k in CONTEXTS[c]}
    return None if plain is None or numbered else read(labelled(plain), *contexts)


def _known(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))


def earlier_totals(rows: DataFrame, kinds: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Of each innings, context and key that its balls count under or ask for: the seven counts in all earlier innings, where there are any.

    One pass over ``rows``: each ball counts once for each context, partly summed before the shuffle; keys are text, '' where there is none.
    """
    width, entries = max((len(k) for k, _ in kinds.values()), default=0), []
    for name, (counted, asked) in kinds.items():
        for keys, asks in ((counted, 0), (asked, 1)) if asked != counted else ((counted, 0),):
            texts = [F.col(k).cast("string") for k in keys] + [F.lit("")] * (width - len(keys))
            entry = F.struct(F.lit(name).alias("context"), F.lit(asks).alias("asks"), *(t.alias(f"key_{i}") for i, t in enumerate(texts)))
            entries.append(F.when(_known(keys), entry))
    by, place = ["context", *(f"key_{i}" for i in range(width))], [*INNINGS, "_span"]
    every = scan.ranged(rows).select(*place, *COUNTS, F.explode(F.array(*entries)).alias("k")).where("k IS NOT NULL").select(*place, *COUNTS, "k.*")
    totals = every.groupBy(*place, *by).agg(*(F.sum(F.when(F.col("asks") == 0, F.col(c)).otherwise(0)).alias(c) for c in COUNTS))
    return scan.exclusive(totals, by, list(COUNTS), ("match_id", "innings")).where(sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])) > 0)


def histories(
    rows: DataFrame, *contexts: str, season: int | None = None, balls: DataFrame | None = None, inside: Callable[..., DataFrame] | None = None,
    sums: dict[str, dict[str, str]] | None = None, overs: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """``rows`` with the seven counts of each of ``contexts`` before each ball, named by the context and the label; only balls of ``season``, if given.

    ``balls``: the balls with keys and counts that ``rows`` are made of, if that is a simpler plan. ``inside`` adds columns from windows over
    innings and a column by which they must be cut too, ``sums`` adds sums of innings (``counted``); both come after the exchange.
    ``overs``: the ``over_totals`` of the balls, in place of all totals of s0 and s1. ``tasks``: of how many tasks ``rows`` come, cut by
    innings; they then stay where they are, and only totals are exchanged.

    What a key has from earlier innings is put in front of the innings as a row of its own, so that one exchange by innings serves all
    contexts. A task passes its innings once, batch by batch, and holds the counts of one innings' keys, never its balls.
    """
    kinds = {c: SIMILAR_KEYS[c] if c in SIMILAR_KEYS else (CONTEXTS[c], CONTEXTS[c]) for c in contexts}
    types = dict(rows.dtypes)
    balls = rows if balls is None else balls
    summed = {c: k for c, k in kinds.items() if overs is None or c not in OVERS}
    carried = earlier_totals(balls if season is None else balls.where(F.col("season_id") <= season), summed)
    if season is not None:
        rows, carried = (d.where(F.col("season_id") == season) for d in (rows, carried))
    values = {c: F.lit(None).cast(types[c]).alias(c) for c in rows.columns} | {c: F.col(c).cast(types[c]).alias(c) for c in INNINGS}
    given = dict(values)
    for key in dict.fromkeys(k for counted, _ in summed.values() for k in counted if k not in INNINGS):
        at = [(c, counted.index(key)) for c, (counted, _) in summed.items() if key in counted]
        text = reduce(lambda out, x: out.when(F.col("context") == x[0], F.col(f"key_{x[1]}")), at[1:], F.when(F.col("context") == at[0][0], F.col(f"key_{at[0][1]}")))
        values[key] = text.cast(types[key]).alias(key)
    wide = rows.withColumns({c: F.col(c).cast("bigint") for c in COUNTS}).withColumn("_context", F.lit(None).cast("string"))
    carried = carried.select(*(v for c, v in values.items() if c not in COUNTS), *COUNTS, F.col("context").alias("_context"))
    if overs is not None:
        given |= {c: F.col(c) for c in SIMILAR_KEYS[OVERS[0]][0]}
        carried = carried.unionByName(overs.select(*(v for c, v in given.items() if c not in COUNTS), *COUNTS, F.col("context").alias("_context")))
    both = wide.unionByName(carried.repartition(tasks, *INNINGS) if tasks else carried)
    both = (both if tasks else both.repartition(*INNINGS)).withColumn("_ball", F.col("_context").isNull())
    if tasks:
        # A window by innings is what tells the planner how rows must lie: a union of parts that lie alike needs no exchange.
        both = both.withColumn("_row", F.row_number().over(Window.partitionBy(*INNINGS).orderBy("_ball", *BALL)))
    both = inside(both, "_ball") if inside else both
    both = both.sortWithinPartitions(*INNINGS, "_ball", *BALL)
    fields = [T.StructField(f.name, f.dataType) for f in both.schema.fields if f.name not in ("_context", "_ball", "_row")]
    kept = [f.name for f in fields]
    fields += [T.StructField(n, T.LongType()) for n in (*(f"{c}_{n}" for c in contexts for n in COUNTS), *(n for of in (sums or {}).values() for n in of))]
    counts = _counted(kinds, kept, INNINGS, sums)
    return both.mapInArrow(counts, T.StructType(fields)).withColumns({c: F.col(c).cast(types[c]) for c in COUNTS if types[c] != "bigint"})


def asof(balls: DataFrame, context: str, plain: DataFrame | None = None) -> DataFrame:
    """Identity of each ball and the context's seven counts before it. ``plain``: the same balls, uncut."""
    got = histories(read(labelled(balls), context), context, balls=plainly(plain, context))
    return got.select(*CHRONOLOGY, *(F.col(f"{context}_{c}").alias(c) for c in COUNTS))


def batter_history(balls: DataFrame) -> DataFrame:
    out = F.when(F.col("player_out") == F.col("batter"), 1).otherwise(0)
    sums = {"career_runs": F.col("batter_runs"), "career_balls": 1 - F.col("is_wide_ball"), "career_outs": out}
    rows = scan.running(balls, ["batter"], CHRONOLOGY, sums).select(*CHRONOLOGY, "batter", *sums)
    return rows.withColumn("career_rate", ratio("career_runs", "career_balls", 100))


def bowler_history(balls: DataFrame) -> DataFrame:
    sums = {"career_conceded": conceded(), "career_balls": F.col("legal_ball"), "career_wickets": F.col("is_wicket")}
    rows = scan.running(balls, ["bowler"], CHRONOLOGY, sums).select(*CHRONOLOGY, "bowler", *sums)
    return rows.withColumn("career_economy", ratio("career_conceded", "career_balls", 6))


def recent_form(balls: DataFrame, role: str, n: int = 5) -> DataFrame:
    """Each player's last ``n`` completed matches before a match: runs and balls batted, or conceded and bowled.

    Matches still going on are not looked at, so no later ball leaks in.
    """
    value, ball = (F.col("batter_runs"), 1 - F.col("is_wide_ball")) if role == "batter" else (conceded(), F.col("legal_ball"))
    by_match = balls.groupBy(role, "season_id", "match_id").agg(F.sum(value).alias("v"), F.sum(ball).alias("b"))
    w = Window.partitionBy(role).orderBy("season_id", "match_id").rowsBetween(-n, -1)
    return by_match.select(
        F.col(role).alias("player"), "season_id", "match_id", F.count("*").over(w).alias("form_matches"),
        F.coalesce(F.sum("v").over(w), F.lit(0)).cast("bigint").alias("form_runs"),
        F.coalesce(F.sum("b").over(w), F.lit(0)).cast("bigint").alias("form_balls"),
    )


def similar_situations(rows: DataFrame) -> DataFrame:
    """The balls of ``rows`` (``labelled``) with counts of similar earlier balls, ``similar_*``, and ``similar_level``."""
    keys = dict.fromkeys(k for parts in SIMILAR_KEYS.values() for names in parts for k in names)
    balls = read(windowed(rows), more=tuple(keys))
    rows = with_similar(histories(balls, *SIMILAR_KEYS, overs=over_totals(balls)))
    return rows.select(*CHRONOLOGY, "similar_level", *(f"similar_{c}" for c in COUNTS))


def over_totals(rows: DataFrame, season: int | None = None) -> DataFrame:
    """Of each innings and key by overs that its balls (``windowed``) ask for: the seven counts in earlier innings, under s0 or s1, where they are
    looked at; asked by ``season`` only, if given.

    A level whose counts in front and in the innings itself are too few is not reached by any of its balls, and the second is not looked
    at where the first has enough in front; their rows are left out. A task takes types, innings and overs through all of time, by sums of innings.
    """
    (strict, enough), (loose, second) = SIMILAR[0], SIMILAR[1]
    group, teams, match = (*loose, "over_window"), tuple(k for k in strict if k not in loose), ("season_id", "match_id")
    asks = F.col("asks") == 1
    at = F.array(*(F.struct(F.col(c).alias("over_window"), F.lit(i).alias("asks")) for i, c in enumerate(("over_window", "asked_window"))))
    every = rows.select(*match, *loose, *teams, *COUNTS, F.explode(at).alias("k")).select(*match, *loose, *teams, *COUNTS, "k.*").where(_known(group))
    if season is not None:
        every = every.where((F.col("season_id") == season) | (~asks & (F.col("season_id") < season)))
    sums = (F.sum(F.when(asks, 0).otherwise(F.col(c))).cast("bigint").alias(c) for c in COUNTS)
    totals = every.groupBy(*match, *loose, *teams, "over_window").agg(*sums, F.max("asks").alias("asks")).repartition(*group)
    size = lambda prefix: sum((F.col(f"{prefix}{c}") for c in COUNTS[1:]), F.col(f"{prefix}{COUNTS[0]}"))
    own = Window.partitionBy(*group, *teams).orderBy(*match).rowsBetween(*BEFORE)
    upto = Window.partitionBy(*group).orderBy(*match).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy(*group, *match)  # an innings' sides may have several names
    rows = totals.select("*", *(F.when(_known(teams), F.coalesce(F.sum(c).over(own), F.lit(0))).otherwise(0).alias(f"s0_{c}") for c in COUNTS))
    rows = rows.withColumns({"s0_n": size("s0_"), "n": size("")})
    rows = rows.select("*", *(F.sum(c).over(upto).alias(f"upto_{c}") for c in COUNTS))
    rows = rows.select(
        "*", *((F.col(f"upto_{c}") - F.sum(c).over(here)).alias(f"s1_{c}") for c in COUNTS), F.sum("n").over(here).alias("here_n"),
        F.min(F.when(asks, F.col("s0_n"))).over(here).alias("fewest"), F.row_number().over(here.orderBy(*teams)).alias("k"),
    )
    first = asks & (F.col("s0_n") > 0) & (F.col("s0_n") + F.col("n") >= enough)
    behind = (F.col("k") == 1) & (F.col("fewest") < enough) & (size("s1_") > 0) & (size("s1_") + F.col("here_n") >= second)
    kept = [F.when(w, F.struct(F.lit(x).alias("context"), *(F.col(f"{x}_{c}").alias(c) for c in COUNTS))) for x, w in zip(OVERS, (first, behind), strict=True)]
    return rows.select(*match, *group, *teams, F.explode(F.array_compact(F.array(*kept))).alias("k")).select(*match, *group, *teams, "k.*")


def windowed(rows: DataFrame) -> DataFrame:
    """``rows`` with the first of the three overs that a ball counts in, and of those that it asks for."""
    return rows.withColumns({"over_window": (F.floor(F.col("over_number") / 3) * 3).cast("int"), "asked_window": (F.floor(F.col("legal_before") / 18) * 3).cast("int")})


def with_similar(rows: DataFrame) -> DataFrame:
    """``rows`` with the strictest level of SIMILAR that has enough balls, ``similar_level``, and its counts, of the histories s0 to s2, in place of these."""
    n = {c: sum((F.col(f"{c}_{x}") for x in COUNTS[1:]), F.col(f"{c}_{COUNTS[0]}")) for c in OVERS}
    rows = rows.withColumn("similar_level", F.when(n["s0"] >= SIMILAR[0][1], 0).when(n["s1"] >= SIMILAR[1][1], 1).otherwise(2))
    at = F.col("similar_level")
    rows = rows.withColumns({f"similar_{c}": F.when(at == 0, F.col(f"s0_{c}")).when(at == 1, F.col(f"s1_{c}")).otherwise(F.col(f"s2_{c}")) for c in COUNTS})
    return rows.drop("over_window", "asked_window", *(f"{x}_{c}" for x in SIMILAR_KEYS for c in COUNTS))
