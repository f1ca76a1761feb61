"""Delivery CSV files: the header's contract, validation with every error of a row, duplicates, rejects and a versioned table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import timeline_key
from . import records

# The columns of the file by kind, in the order in which their errors are reported.
INTEGERS = ("season_id", "match_id", "over_number", "ball_number", "batter_runs", "extras", "total_runs", "wide_ball_runs",
            "no_ball_runs", "leg_bye_runs", "bye_runs", "penalty_runs", "innings")
BOOLEANS = ("is_wicket", "is_wide_ball", "is_no_ball", "is_leg_bye", "is_bye", "is_penalty", "is_super_over")
TEXTS = ("batter", "bowler", "non_striker", "team_batting", "team_bowling", "batsman_type", "bowler_type", "player_out",
         "fielders_involved", "wicket_kind")
REQUIRED = ("batter", "bowler", "team_batting", "team_bowling")
TRUE, FALSE = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
IDENTITY = ("season_id", "match_id", "innings", "over_number", "ball_number")
COLUMNS = (*INTEGERS, *BOOLEANS, *TEXTS)


def header_problems(columns: list[str]) -> tuple[list[str], list[str]]:
    """Columns of the contract that a header lacks, which is fatal, and those beyond it, which are left out."""
    return [c for c in COLUMNS if c not in columns], [c for c in columns if c not in COLUMNS]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the file as text, with ``source_row_number`` counted from 2 in the order of the file, and ``problem``.

    Quoted commas, quotes and line breaks are read in splits (``records``). A record that cannot be read, or has too few or too many
    fields, has a problem, which rejects it. A missing column is an error; columns beyond the contract are left out.
    """
    names = records.header(spark, path)
    missing, _ = header_problems(names)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = records.parsed(records.records(records.lines(spark, path)), names, COLUMNS)
    return rows.select(*COLUMNS, F.col("row").alias("source_row_number"), "problem")


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _integer(c: str) -> Column:
    """Integers, and decimals that are whole within 1e-9."""
    d = F.expr(f"try_cast(trim(`{c}`) AS double)")
    return F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS int)"), F.when(F.abs(d - F.round(d)) < 1e-9, F.round(d).try_cast("int")))


def _boolean(c: str) -> Column:
    value = F.lower(F.trim(c))
    return F.when(value.isin(*TRUE), 1).when(value.isin(*FALSE), 0)


def validated(raw: DataFrame) -> DataFrame:
    """``raw`` normalised, with ``legal_ball`` and ``errors``: the codes of all that is wrong with a row, in fixed order."""
    problem = F.col("problem") if "problem" in raw.columns else F.lit(None).cast("string")
    parsed = raw.select(
        *(_integer(c).alias(c) for c in INTEGERS), *(_boolean(c).alias(c) for c in BOOLEANS), *(_text(c).alias(c) for c in TEXTS),
        "source_row_number", F.struct(*(F.col(c) for c in COLUMNS)).alias("raw"), problem.alias("problem"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    given = lambda c: F.col(f"raw.{c}")
    errors = [F.col("problem")]
    errors += [
        F.when(F.coalesce(F.trim(given(c)), F.lit("")) == "", f"missing:{c}").when(F.col(c).isNull(), F.concat(F.lit(f"not_integer:{c}="), given(c)))
        for c in INTEGERS
    ]
    errors += [F.when(F.col(c).isNull(), F.concat(F.lit(f"invalid_boolean:{c}="), F.coalesce(given(c), F.lit("")))) for c in BOOLEANS]
    errors += [F.when(F.col(c).isNull(), f"missing:{c}") for c in REQUIRED]
    breakdown = functools.reduce(lambda a, b: a + b, map(n, ("wide_ball_runs", "no_ball_runs", "leg_bye_runs", "bye_runs", "penalty_runs")))
    detail = F.col("player_out").isNotNull() | F.col("wicket_kind").isNotNull()
    errors += [
        F.when(n("batter_runs") + n("extras") != n("total_runs"), "run_total_mismatch"),
        F.when(n("extras") != breakdown, "extras_breakdown_mismatch"),
        F.when((n("is_wicket") == 1) & ~detail, "wicket_flag_without_detail").when((n("is_wicket") == 0) & detail, "wicket_detail_without_flag"),
        F.when(n("over_number") < 0, "negative_over_number"), F.when(n("ball_number") < 0, "negative_ball_number"),
    ]
    legal = F.when((n("is_wide_ball") == 1) | (n("is_no_ball") == 1), 0).otherwise(1)
    rows = parsed.withColumns({"legal_ball": legal, "errors": F.array_compact(F.array(*errors))}).drop("problem")
    # An earlier row claims its identity, whether it is valid or not.
    known = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), IDENTITY, F.lit(True))
    again = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("source_row_number")) > 1
    twice = F.when(known & again, F.array(F.lit("duplicate_delivery_identity"))).otherwise(F.array())
    return rows.withColumn("errors", F.concat("errors", twice))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows without errors, with ``timeline_key``, whose order as text is the order of play."""
    return rows.where(F.size("errors") == 0).drop("errors", "raw").withColumn("timeline_key", timeline_key())


def rejected(rows: DataFrame) -> DataFrame:
    """Row number, first error, all errors joined by a bar, and the row as JSON."""
    return rows.where(F.size("errors") > 0).select(
        "source_row_number", F.element_at("errors", 1).alias("reason"), F.array_join("errors", "|").alias("errors"), F.to_json("raw").alias("raw")
    )


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Later rows of an identity, with which occurrence of it they are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w).cast("bigint")).where("occurrence > 1")


def profile(raw: DataFrame) -> DataFrame:
    """One row: rows, exact repeats, kinds of errors, of each column its blanks and values that do not parse, balls in a match, super overs."""
    rows = validated(raw)
    blank = [F.sum(F.when(F.coalesce(F.trim(f"raw.{c}"), F.lit("")) == "", 1).otherwise(0)).alias(f"blank_{c}") for c in COLUMNS]
    has = lambda code: F.sum(F.when(F.exists("errors", lambda e: e.startswith(code)), 1).otherwise(0))
    codes = ("not_integer", "invalid_boolean", "run_total_mismatch", "extras_breakdown_mismatch", "wicket_flag_without_detail", "wicket_detail_without_flag", "duplicate_delivery_identity")
    bad = [has(f"not_integer:{c}=").alias(f"bad_{c}") for c in INTEGERS] + [has(f"invalid_boolean:{c}=").alias(f"bad_{c}") for c in BOOLEANS]
    whole = rows.agg(F.count("*").alias("rows"), *(has(c).alias(c) for c in codes), *blank, *bad, F.sum("is_super_over").alias("super_over_rows"))
    repeats = raw.groupBy(*COLUMNS).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("exact_repeats"))
    match = rows.where("match_id IS NOT NULL").groupBy("season_id", "match_id").agg(F.count("*").alias("n"))
    match = match.agg(F.min("n").alias("least_balls"), F.max("n").alias("most_balls"), F.avg("n").alias("mean_balls"))
    return whole.crossJoin(repeats).crossJoin(match)  # one row each


def latest(rows: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Upsert: of each key the row of the latest ``batch``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(batch))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert that keeps old values where the new ones are null."""
    values = [c for c in old.columns if c not in keys]
    joined = new.alias("n").join(old.alias("o"), keys, "full")
    return joined.select(*keys, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values))


def better_known(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of identities (``key``, full_name, confidence): an old name stays, the confidence is the larger one."""
    joined = new.alias("n").join(old.alias("o"), key, "full")
    return joined.select(key, F.coalesce("o.full_name", "n.full_name").alias("full_name"), F.greatest("o.confidence", "n.confidence").alias("confidence"))


def season_of(raw: Column) -> Column:
    """The season of a label: 2020/21 is 2020, other spans end in their second year, else the latest year named."""
    spans = F.regexp_extract(raw, r"^(\d{4})/(\d{2})$", 2)
    years = F.array_max(F.transform(F.regexp_extract_all(raw, F.lit(r"(\d{4})")), lambda y: y.cast("int")))
    return F.when(raw == "2020/21", 2020).when(spans != "", F.concat(F.substring(raw, 1, 2), spans).try_cast("int")).otherwise(years)


MATCH_JSON = (
    "info struct<season:string, dates:array<string>, teams:array<string>, venue:string, toss:struct<winner:string, decision:string>, "
    "outcome:struct<winner:string, result:string, by:struct<runs:int, wickets:int>>>, "
    "innings array<struct<team:string, super_over:boolean, overs:array<struct<over:int, deliveries:array<struct<batter:string, "
    "bowler:string, non_striker:string, runs:struct<batter:int, extras:int, total:int>, extras:struct<wides:int, noballs:int, "
    "legbyes:int, byes:int, penalty:int>, wickets:array<struct<player_out:string, kind:string, fielders:array<struct<name:string>>>>>>>>>>"
)


def flattened(matches: DataFrame) -> DataFrame:
    """One row per ball of nested match records (``MATCH_JSON``, with match_id); balls are numbered from 1 in their over."""
    overs = matches.select("match_id", season_of(F.col("info.season")).alias("season_id"), F.posexplode("innings").alias("i", "inning")).select(
        "match_id", "season_id", (F.col("i") + 1).alias("innings"), "inning.team", "inning.super_over", F.explode("inning.overs").alias("o")
    )
    balls = overs.select("*", F.posexplode("o.deliveries").alias("k", "d"))
    extra = lambda c: F.coalesce(F.col(f"d.extras.{c}"), F.lit(0))
    wicket = F.try_element_at("d.wickets", F.lit(1))
    return balls.select(
        "season_id", "match_id", "innings", F.col("o.over").alias("over_number"), (F.col("k") + 1).alias("ball_number"),
        F.col("team").alias("team_batting"), "d.batter", "d.bowler", "d.non_striker", F.col("d.runs.batter").alias("batter_runs"),
        F.col("d.runs.extras").alias("extras"), F.col("d.runs.total").alias("total_runs"), extra("wides").alias("wide_ball_runs"),
        extra("noballs").alias("no_ball_runs"), extra("legbyes").alias("leg_bye_runs"), extra("byes").alias("bye_runs"),
        extra("penalty").alias("penalty_runs"), wicket["player_out"].alias("player_out"), wicket["kind"].alias("wicket_kind"),
        F.array_join(F.transform(wicket["fielders"], lambda f: f["name"]), ", ").alias("fielders_involved"),
        wicket.isNotNull().cast("int").alias("is_wicket"), F.coalesce("super_over", F.lit(False)).cast("int").alias("is_super_over"),
    )


def match_records(matches: DataFrame) -> DataFrame:
    """One row per nested record: season, date, venue, teams, toss, winner, and how the match was won (runs before wickets)."""
    i = lambda path: F.col(f"info.{path}")
    runs, wickets = i("outcome.by.runs"), i("outcome.by.wickets")
    return matches.select(
        "match_id", season_of(i("season")).alias("season_id"), F.try_element_at(i("dates"), F.lit(1)).cast("date").alias("match_date"), i("venue").alias("venue"),
        F.try_element_at(i("teams"), F.lit(1)).alias("team_a"), F.try_element_at(i("teams"), F.lit(2)).alias("team_b"),
        i("toss.winner").alias("toss_winner"), i("toss.decision").alias("toss_decision"), i("outcome.winner").alias("winner"),
        F.when(runs.isNotNull(), "runs").when(wickets.isNotNull(), "wickets").alias("result_type"), F.coalesce(runs, wickets).alias("margin"),
    )


def backfill(matches: DataFrame, balls: DataFrame) -> DataFrame:
    """Balls of the latest season's nested records whose matches ``balls`` do not have."""
    found = flattened(matches)
    newest = found.agg(F.max("season_id").alias("season_id"))
    return found.join(F.broadcast(newest), "season_id", "left_semi").join(balls.select("match_id").distinct(), "match_id", "left_anti")  # newest: one row


def team_codes(matches: DataFrame, balls: DataFrame) -> DataFrame:
    """(match_id, code, team): the i-th innings of the nested record and of ``balls`` name the same side."""
    theirs = matches.select("match_id", F.posexplode("innings").alias("i", "x")).select("match_id", (F.col("i") + 1).alias("innings"), F.col("x.team").alias("team"))
    ours = balls.groupBy("match_id", "innings").agg(F.min("team_batting").alias("code"))
    return theirs.join(ours, ["match_id", "innings"]).groupBy("match_id", "code").agg(F.min("team").alias("team"))


def named_teams(balls: DataFrame, codes: DataFrame) -> DataFrame:
    """``balls`` with batting_name: the side's name by match and code, the code itself where there is none."""
    names = codes.select("match_id", F.col("code").alias("team_batting"), "team")
    return balls.join(names, ["match_id", "team_batting"], "left").withColumn("batting_name", F.coalesce("team", "team_batting")).drop("team")


def nested(balls: DataFrame) -> DataFrame:
    """Match records (``MATCH_JSON``, with match_id and its season as text) made of deliveries: innings, overs and balls in order."""
    extras = F.struct(*(F.col(c).cast("int").alias(n) for c, n in (("wide_ball_runs", "wides"), ("no_ball_runs", "noballs"), ("leg_bye_runs", "legbyes"), ("bye_runs", "byes"), ("penalty_runs", "penalty"))))
    runs = F.struct(F.col("batter_runs").cast("int").alias("batter"), F.col("extras").cast("int").alias("extras"), F.col("total_runs").cast("int").alias("total"))
    fielders = F.transform(F.split("fielders_involved", ", "), lambda f: F.struct(f.alias("name")))
    wicket = F.when(F.col("is_wicket") == 1, F.array(F.struct("player_out", F.col("wicket_kind").alias("kind"), fielders.alias("fielders"))))
    ball = F.struct("ball_number", "source_row_number", F.struct("batter", "bowler", "non_striker", runs.alias("runs"), extras.alias("extras"), wicket.alias("wickets")).alias("d"))
    place = ["season_id", "match_id", "innings", "team_batting", "is_super_over"]
    in_order = lambda rows, field: F.transform(F.sort_array(F.collect_list(rows)), lambda x: x[field])
    overs = balls.groupBy(*place, "over_number").agg(in_order(ball, "d").alias("deliveries"))  # a match at most, at each step
    over = F.struct("over_number", F.struct(F.col("over_number").alias("over"), "deliveries").alias("o"))
    innings = overs.groupBy(*place).agg(in_order(over, "o").alias("overs"))
    one = F.struct("innings", F.struct(F.col("team_batting").alias("team"), (F.col("is_super_over") == 1).alias("super_over"), "overs").alias("i"))
    found = innings.groupBy("season_id", "match_id").agg(in_order(one, "i").alias("innings"))
    return found.select("match_id", F.struct(F.col("season_id").cast("string").alias("season")).alias("info"), "innings")


def nested_quality(matches: DataFrame) -> DataFrame:
    """By season of nested records, without a row for a ball: matches, balls, fours, sixes, wickets and dots, as ``season_quality`` has them.

    A fold goes through a record's innings, overs and balls and carries the counts along; records are summed by season. Missing or
    null lists hold nothing; a record without a season is left out.
    """
    names = ("deliveries", "fours", "sixes", "wickets", "dots", "batter_dots")

    def add(n: Column, d: Column) -> Column:
        runs = lambda c: F.coalesce(d["runs"][c], F.lit(0))
        legal = (F.coalesce(d["extras"]["wides"], F.lit(0)) == 0) & (F.coalesce(d["extras"]["noballs"], F.lit(0)) == 0)
        out = F.coalesce(F.size(d["wickets"]) > 0, F.lit(False))
        tests = (F.lit(True), runs("batter") == 4, runs("batter") == 6, out, legal & (runs("total") == 0), legal & (runs("batter") == 0))
        return F.struct(*((n[c] + F.when(t, 1).otherwise(0)).alias(c) for c, t in zip(names, tests, strict=True)))

    def fold(rows: Column, n: Column, step) -> Column:
        return F.coalesce(F.aggregate(rows, n, step), n)

    zero = F.struct(*(F.lit(0).alias(c) for c in names))
    counted = fold(F.col("innings"), zero, lambda n, i: fold(i["overs"], n, lambda m, o: fold(o["deliveries"], m, add)))
    rows = matches.select(season_of(F.col("info.season")).alias("season_id"), "match_id", counted.alias("n")).where("season_id IS NOT NULL")
    sums = (F.sum(f"n.{c}").cast("bigint").alias(c) for c in names)
    return rows.groupBy("season_id").agg(F.countDistinct("match_id").alias("matches"), *sums)
