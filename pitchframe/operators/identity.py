"""Player names: clean names, an index of aliases, and names told from what was asked, ranked by how well they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3  #: characters by which questions and aliases meet
# What statuses are worth; points for an equal, a beginning and a contained alias, for a shared word; balls that earn a
# point and the most that count; points and lead that settle a name; candidates named.
STATUS = {"verified": 3, "provisional": 2, "derived": 1}
EQUAL, BEGINS, HOLDS, WORD, RANK = 120.0, 35.0, 18.0, 16.0, 25.0
BALLS_A_POINT, MOST_BALLS = 250.0, 5000
ENOUGH, LEAD, NAMED = 130.0, 24.0, 8


def norm(name: Column) -> Column:
    """Lower case, everything but a-z and digits a single space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def clean(name: Column) -> Column:
    """The name without blanks at its ends; of a list with one quoted name that name; null for other lists and for nothing."""
    value = F.trim(name)
    one = F.trim(F.regexp_extract(value, r"""^\[\s*(['"])([^'"]*)\1\s*\]$""", 2))
    value = F.when(value.startswith("["), one).otherwise(value)
    return F.when((value != "") & ~value.contains("',") & ~value.startswith("["), value)


def aliases(players: DataFrame) -> DataFrame:
    """(alias, player, status): a player's name, its words, its last word, first and last, initial and last."""
    rows = players.select(clean(F.col("player")).alias("player")).where("player IS NOT NULL").distinct()
    words = F.split(norm(F.col("player")), " ")
    first, last, n = F.element_at(words, 1), F.element_at(words, -1), F.size(words)
    two = F.when(n >= 2, F.concat_ws(" ", first, last))
    initial = F.when(n >= 2, F.concat_ws(" ", F.substring(first, 1, 1), last))
    forms = F.array("player", F.concat_ws(" ", words), F.concat_ws("", words), last, two, initial)
    found = rows.select(F.explode(F.array_distinct(F.array_compact(forms))).alias("alias"), "player").where("alias <> ''")
    return found.withColumn("status", F.lit("derived"))


def candidates(questions: DataFrame, index: DataFrame, activity: DataFrame) -> DataFrame:
    """(query, player, score) of every player with an alias that holds the question.

    Questions and aliases meet by the first characters of the question, which any alias that holds it has too.
    """
    asked = questions.select("query", norm(F.col("query")).alias("asked")).where("asked <> ''").distinct()
    asked = asked.withColumn("gram", F.substring("asked", 1, GRAM))
    form = index.withColumn("form", norm(F.col("alias")))
    spots = F.sequence(F.lit(1), F.length("form"))
    grams = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("form", i, n)))))
    met = form.where("form <> ''").select("form", "player", "status", F.explode(grams).alias("gram")).join(asked, "gram")
    met = met.where(F.col("form").contains(F.col("asked"))).join(activity, "player", "left")
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.lower("status")), F.lit(0))
    fit = F.when(F.col("form") == F.col("asked"), EQUAL).when(F.col("form").startswith(F.col("asked")), BEGINS).otherwise(HOLDS)
    shared = F.size(F.array_intersect(F.split("asked", " "), F.split(norm(F.col("player")), " ")))
    balls = F.least(F.coalesce("activity", F.lit(0)), F.lit(MOST_BALLS)) / BALLS_A_POINT
    return met.groupBy("query", "player").agg(F.max(rank * RANK + fit + shared * WORD + balls).alias("score"))


def resolved(questions: DataFrame, index: DataFrame, activity: DataFrame) -> DataFrame:
    """By question: the player it names (null if that is not clear), and the best candidates, best first."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "player")
    rows = candidates(questions, index, activity).withColumn("k", F.row_number().over(w)).where(F.col("k") <= NAMED)
    best = rows.groupBy("query").agg(
        F.max(F.when(F.col("k") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("k") == 1, F.col("player"))).alias("first"), F.sort_array(F.collect_list(F.struct("k", "player"))).alias("ranked"),
    )
    clear = F.col("second").isNull() | ((F.col("top") >= ENOUGH) & (F.col("top") >= F.col("second") + LEAD))
    names = F.array_join(F.transform("ranked", lambda r: r["player"]), "|")
    found = best.select("query", F.when(clear, F.col("first")).alias("player"), names.alias("candidates"))
    return questions.select("query").distinct().join(found, "query", "left")
