"""Misspelt names: a similarity join of words and the ratio of their longest matching blocks, and names told from it.

The ratio of two words is twice the letters in matching blocks over all letters. Blocks are the longest common run, the earliest of
equals, and so on to its left and right. Words at least ``LEAST_LAST`` alike differ so little that they share several pairs of letters
(``shared_grams``); so a word is looked up by its rarest pairs only, as many as guarantee one in common, among words whose length allows
the ratio. Words are compared once, however many names have them.

Defined results: null and empty questions, and questions or names of one word, have no fuzzy match; words count by characters; equal
scores go by name; a name's repeats count once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import NAMED, norm

# The least ratio of last and first words, what they are worth, and the lead that settles a name.
LEAST_LAST, LEAST_FIRST = 0.82, 0.34
LAST, FIRST, LEAD = 80.0, 20.0, 16.0
GRAM = 2
AT_ONCE = 40  #: letters of words that are compared many at once


def matched(a: str, b: str) -> int:
    """The letters of two words in matching blocks."""
    todo, total = [(0, len(a), 0, len(b))], 0
    while todo:
        a0, a1, b0, b1 = todo.pop()
        found = ((i, j, n) for n in range(min(a1 - a0, b1 - b0), 0, -1) for i in range(a0, a1 - n + 1) if (j := b.find(a[i : i + n], b0, b1)) >= 0)
        i, j, n = next(found, (0, 0, 0))
        if n:
            total += n
            todo += (a0, i, b0, j), (i + n, a1, j + n, b1)
    return total


def matched_each(a: pd.Series, b: pd.Series) -> np.ndarray:
    """``matched`` of many pairs at once: all boxes of a round are searched together, letter by letter of the first word; long words one by one."""
    out, n, m = np.zeros(len(a), np.int32), a.str.len().to_numpy(np.int64), b.str.len().to_numpy(np.int64)
    long = (n > AT_ONCE) | (m > AT_ONCE)
    out[long] = [matched(u, v) for u, v in zip(a[long], b[long], strict=True)]
    at = np.flatnonzero(~long)
    if not len(at):
        return out

    def letters(words: pd.Series):
        fixed = words.to_numpy(f"U{max(words.str.len().max(), 1)}")
        return fixed.view(np.uint32).reshape(len(fixed), -1)

    x, y = letters(a[~long]), letters(b[~long])
    box = np.stack([np.arange(len(at)), np.zeros_like(at), n[at], np.zeros_like(at), m[at]])
    spots = np.arange(y.shape[1])
    while box.shape[1]:
        row, a0, a1, b0, b1 = box
        u, v = x[row], y[row]
        free = (spots >= b0[:, None]) & (spots < b1[:, None])
        run = np.zeros((len(row), len(spots)), np.int16)
        most, i, j = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for k in range(a0.min(), a1.max()):
            same = (u[:, k, None] == v) & free & ((a0 <= k) & (k < a1))[:, None]
            grown = np.zeros_like(run)
            grown[:, 1:] = run[:, :-1]
            run = np.where(same, grown + 1, 0).astype(np.int16)
            end = run.argmax(axis=1)  # the first of equals
            length = run[np.arange(len(row)), end].astype(np.int64)
            better = length > most  # and the earliest in the first word
            most[better], i[better], j[better] = length[better], k + 1 - length[better], end[better] + 1 - length[better]
        np.add.at(out, at[row], most.astype(np.int32))
        left, right = np.stack([row, a0, i, b0, j]), np.stack([row, i + most, a1, j + most, b1])
        box = np.concatenate([left[:, most > 0], right[:, most > 0]], axis=1)
        box = box[:, (box[1] < box[2]) & (box[3] < box[4])]
    return out


def ratio(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``pairs`` with the matching-block ratio of two columns of words that are not empty, in as many tasks as shuffles have: pairs are small
    and take long, so their size says nothing of the work."""

    @F.pandas_udf("int")
    def letters(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(matched_each(x, y))

    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by columns it would be taken for that of a distinct
    return pairs.withColumn(name, 2.0 * letters(a, b) / (F.length(a) + F.length(b)))


def shared_grams(n: Column, m: Column, least: float) -> Column:
    """Pairs of letters that words of n and m letters share at least, if their ratio is ``least`` or more: with M letters in blocks there
    are at most n + m - 2 M + 1 blocks, each of one pair less than its letters."""
    matched = F.ceil((n + m) * (least / 2) - 1e-9)
    return 3 * matched - (n + m) - 1


def grams(word: Column) -> Column:
    """The word's pairs of letters with how often each was met before in it, so that repeats count; the letter itself for one."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(word) - GRAM + 1, F.lit(1)))
    found = F.transform(spots, lambda i: F.substring(word, i, F.lit(GRAM)))
    return F.transform(found, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def letters_in(word: Column) -> Column:
    """A bit for each letter of the word, by its code modulo 64."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(F.substring(word, i, F.lit(1))) % 64)
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.lit(0).cast("bigint"), lambda x, i: x.bitwiseOR(bit(i)))


def may_be_alike(n: str, has: str, m: str, other_has: str, least: float) -> Column:
    """Whether words of ``n`` and ``m`` letters, with these ``letters_in``, can be ``least`` alike: a letter that the other has not at all is in no block."""
    left = lambda n, x, y: F.col(n) - F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    return 2 * F.least(left(n, has, other_has), left(m, other_has, has)) >= least * (F.col(n) + F.col(m)) - 1e-9


def similar_words(asked: DataFrame, known: DataFrame, least: float = LEAST_LAST) -> DataFrame:
    """(word, other, ratio): words of ``asked`` and ``known`` (each a column word) at least ``least`` alike. A ratio at which short words
    need have no pair of letters in common, below 0.82 or so, is an error."""
    if least <= 2 / 3 or any(3 * math.ceil(t * least / 2 - 1e-9) <= t + 1 for t in range(4, 64)):
        raise ValueError(f"words {least} alike may share no pair of letters")
    mine, theirs = (d.where("word <> ''").select("word").distinct().withColumns({"n": F.length("word"), "has": letters_in(F.col("word"))}) for d in (asked, known))
    listed = theirs.select(F.col("word").alias("other"), F.col("n").alias("m"), F.col("has").alias("other_has"), F.explode(grams(F.col("word"))).alias("gram"))
    common = listed.groupBy("gram").agg(F.count("*").alias("words"))
    # Of any partner's length, the fewest pairs in common; all others but so many may be missed.
    lengths = F.sequence(F.ceil(F.col("n") * (least / (2 - least)) - 1e-9).cast("int"), F.floor(F.col("n") * ((2 - least) / least) + 1e-9).cast("int"))
    fewest = F.array_min(F.transform(lengths, lambda m: F.when(F.col("n") + m <= 3, F.lit(1)).otherwise(shared_grams(F.col("n"), m, least).cast("int"))))
    rows = mine.withColumn("fewest", F.greatest(fewest, F.lit(1))).select("*", F.explode(grams(F.col("word"))).alias("gram"))
    rarest = Window.partitionBy("word").orderBy(F.coalesce("words", F.lit(0)), "gram")
    rows = rows.join(common, "gram", "left").withColumn("k", F.row_number().over(rarest))
    rows = rows.where(F.col("k") <= F.greatest(F.col("n") - GRAM + 1, F.lit(1)) - F.col("fewest") + 1).where("words IS NOT NULL")
    met = rows.join(listed, "gram").where(may_be_alike("n", "has", "m", "other_has", least))
    return ratio(met.select("word", "other").distinct(), "word", "other", "ratio").where(F.col("ratio") >= least)


def fuzzy(questions: DataFrame, players: DataFrame) -> DataFrame:
    """(query, player, score) of players whose first and last words are like the question's."""
    words = lambda c: F.split(norm(F.col(c)), " ")
    ends = lambda c: (F.element_at(words(c), 1).alias("first"), F.element_at(words(c), -1).alias("word"))
    has = lambda word, n, has: {n: F.length(word), has: letters_in(F.col(word))}
    asked = questions.select("query", *ends("query")).where(F.size(words("query")) >= 2).distinct()
    known = players.select("player", *ends("player")).where(F.size(words("player")) >= 2).distinct()
    alike = similar_words(asked, known)
    named = known.select("player", F.col("first").alias("initial"), F.col("word").alias("other")).withColumns(has("initial", "m", "other_has"))
    # Most of a name's first words are told apart by their letters, before pairs of names are listed.
    may = F.when(F.col("m") == 1, F.col("initial") == F.substring("first", 1, 1)).otherwise(may_be_alike("n", "has", "m", "other_has", LEAST_FIRST))
    met = asked.withColumns(has("first", "n", "has")).join(alike, "word").join(named, "other").where(may).drop("n", "has", "m", "other_has")
    firsts = met.select("first", "initial").distinct()
    one = F.length("initial") == 1
    firsts = ratio(firsts.where(~one), "first", "initial", "like").unionByName(firsts.where(one).withColumn("like", F.lit(1.0)))
    met = met.join(firsts.where(F.col("like") >= LEAST_FIRST), ["first", "initial"])
    return met.select("query", "player", (F.col("ratio") * LAST + F.col("like") * FIRST).alias("score"))


def told(scores: DataFrame, questions: DataFrame, lead: float = LEAD) -> DataFrame:
    """By question: the player who leads clearly or is alone (else null), and the best candidates, best first."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "player")
    rows = scores.withColumn("k", F.row_number().over(w)).where(F.col("k") <= NAMED)
    best = rows.groupBy("query").agg(
        F.max(F.when(F.col("k") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("k") == 1, F.col("player"))).alias("best"), F.sort_array(F.collect_list(F.struct("k", "player"))).alias("ranked"),
    )
    clear = F.col("second").isNull() | (F.col("top") >= F.col("second") + lead)
    names = F.array_join(F.transform("ranked", lambda r: r["player"]), "|")
    found = best.select("query", F.when(clear, F.col("best")).alias("player"), names.alias("candidates"))
    return questions.select("query").distinct().join(found, "query", "left")


def resolved_or_similar(questions: DataFrame, ranked: DataFrame, players: DataFrame) -> DataFrame:
    """``identity.resolved`` with the clear fuzzy match where no alias tells a player, and fuzzy candidates where there are none."""
    open_ = ranked.where("player IS NULL").select("query")
    like = told(fuzzy(open_, players), open_).select("query", F.col("player").alias("like"), F.col("candidates").alias("likely"))
    joined = ranked.join(like, "query", "left")
    names = F.when(F.col("player").isNull() & F.col("like").isNotNull(), F.col("likely")).otherwise(F.coalesce("candidates", "likely"))
    return joined.select("query", F.coalesce("player", "like").alias("player"), names.alias("candidates"))
