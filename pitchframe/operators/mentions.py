"""Names in free text: dictionary matching with longest match, of teams and players.

A question becomes the runs of 1 to ``LONGEST`` words at each place; runs equal to an alias are found by an equi-join with the alias
table, on the number of words and the run itself, so a question meets only aliases that it holds. A fold over a question's matches, longest
first, keeps those that overlap none kept before. A mention names all that its alias stands for: one team or player is told, several are
listed.

Defined results: null and empty questions mention nothing; names are listed in order; an alias of more words than ``LONGEST`` is
matched by none; equally long matches that overlap are kept from the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import norm

LONGEST = 5
# Names listed; the words of equal surnames that leave a name open; letters of a possessive and the balls and lead that tell its player.
NAMED, OPEN = 6, 3
POSSESSIVE, ENOUGH_BALLS, TIMES = 4, 500, 2


def tokens(text: str) -> Column:
    return F.filter(F.split(norm(F.col(text)), " "), lambda w: w != "")


def runs(questions: DataFrame) -> DataFrame:
    """(query, i, width, form): every run of words of each question, and the place of its first."""
    asked = questions.select("query").where("query IS NOT NULL").distinct().withColumn("words", tokens("query")).where(F.size("words") > 0)
    widths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("words")))
    each = F.transform(widths, lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("width"), F.array_join(F.slice("words", i, n), " ").alias("form"))))
    return asked.select("query", F.explode(F.flatten(each)).alias("r")).select("query", "r.*")


def kept(matches: Column) -> Column:
    """Of an array of structs (width, i, ...) those that stay: longest first, then from the left, none overlapping one before."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct((-m["width"]).alias("n"), m["i"].alias("i"), m.alias("m"))))
    apart = lambda m: lambda k: (m["i"] + m["width"] <= k["i"]) | (k["i"] + k["width"] <= m["i"])
    none = F.slice(F.transform(order, lambda o: o["m"]), F.lit(1), F.lit(0))
    return F.aggregate(order, none, lambda got, o: F.when(F.forall(got, apart(o["m"])), F.concat(got, F.array(o["m"]))).otherwise(got))


def mentions(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(query, i, width, form, names): the longest matches of each question with ``index`` (alias, name), and all that each may name."""
    forms = index.select(norm(F.col("alias")).alias("form"), "name").where("form <> '' AND name IS NOT NULL")
    table = forms.groupBy("form").agg(F.sort_array(F.collect_set("name")).alias("names")).withColumn("width", F.size(F.split("form", " ")))
    found = runs(questions).join(table, ["width", "form"])
    # A question has at most LONGEST matches at each of its words.
    whole = found.groupBy("query").agg(F.collect_list(F.struct("width", "i", "form", "names")).alias("matches"))
    return whole.select("query", F.explode(kept(F.col("matches"))).alias("m")).select("query", "m.i", "m.width", "m.form", "m.names")


def _listed(names: Column) -> Column:
    return F.nullif(F.array_join(F.slice(names, 1, NAMED), "|"), F.lit(""))


def team_aliases(teams: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(alias, name) of ``teams`` (team, display): the team's code, its display name, the initials of its words if there are two or more, and
    those of ``more`` (alias, name)."""
    initials = F.array_join(F.transform(tokens("display"), lambda w: F.substring(w, 1, 1)), "")
    forms = F.array(norm(F.col("team")), norm(F.col("display")), F.when(F.length(initials) >= 2, initials))
    rows = teams.select(F.explode(F.array_distinct(F.array_compact(forms))).alias("alias"), F.col("team").alias("name")).where("alias <> ''")
    return (rows.unionByName(more.select(norm(F.col("alias")).alias("alias"), "name").where("alias <> ''")) if more is not None else rows).distinct()


def teams_named(questions: DataFrame, index: DataFrame) -> DataFrame:
    """By question: the team it names (null for none or several), all that it may name, and how many mentions it has."""
    found = mentions(questions, index).groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.count("*").alias("mentions"))
    told = F.when(F.size("names") == 1, F.element_at("names", 1))
    found = found.select("query", told.alias("team"), _listed(F.col("names")).alias("candidates"), "mentions")
    return questions.select("query").distinct().join(found, "query", "left").fillna(0, ["mentions"])


def players_named(questions: DataFrame, index: DataFrame, activity: DataFrame) -> DataFrame:
    """(query, i, form, player, candidates) of each mention of a player.

    ``index``: (alias, player); ``activity``: (player, activity). A mention of several players is told by the word in front of it, if that
    begins like the first word of one of them alone. A question that mentions nobody may name a player by a possessive: the most active one
    whose name begins like it, if clearly ahead.
    """
    found = mentions(questions, index.select("alias", F.col("player").alias("name")))
    before = questions.select("query").distinct().withColumn("words", tokens("query"))
    found = found.join(before, "query").withColumn("before", F.when(F.col("i") > 1, F.element_at("words", F.col("i") - 1)))
    first_letter = lambda p: F.substring(F.regexp_replace(F.lower(p), "[^a-z0-9]", ""), 1, 1)
    fits = F.filter("names", lambda p: first_letter(p) == F.substring("before", 1, 1))
    told = F.when(F.size("names") == 1, F.element_at("names", 1)).when(F.col("before").isNotNull() & (F.size(fits) == 1), F.element_at(fits, 1))
    named = found.select("query", "i", "form", told.alias("player"), _listed(F.col("names")).alias("candidates"))

    asked = questions.select("query").distinct().join(found.select("query").distinct(), "query", "left_anti")
    owners = F.regexp_extract_all("query", F.lit(rf"\b([A-Za-z]{{{POSSESSIVE},}})'s\b"), 1)
    owners = asked.select("query", F.posexplode(owners).alias("i", "owner")).select("query", "i", F.lower("owner").alias("form"))
    ranked = activity.where("player IS NOT NULL").withColumn("initial", first_letter(F.col("player"))).where("initial <> ''")
    order = Window.partitionBy("initial").orderBy(F.desc("activity"), "player")
    top = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= NAMED)  # ranked in each task first
    lead = top.groupBy("initial").agg(
        F.max(F.when(F.col("k") == 1, F.col("activity"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("activity"))).alias("next"),
        F.max(F.when(F.col("k") == 1, F.col("player"))).alias("player"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "player"))), lambda r: r["player"]), "|").alias("candidates"),
    ).where((F.col("best") >= ENOUGH_BALLS) & (F.col("best") >= TIMES * F.col("next")))
    owned = owners.withColumn("initial", F.substring("form", 1, 1)).join(lead, "initial")
    first = owned.groupBy("query").agg(F.min_by(F.struct("i", "form", "player", "candidates"), "i").alias("m"))
    return named.unionByName(first.select("query", F.lit(0).alias("i"), "m.form", "m.player", "m.candidates"))
