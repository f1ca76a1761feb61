"""Matching-block ratios and the similarity join against the standard library, and names told from misspelt ones."""

import difflib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import identity, similar

WORDS = ["suryavanshi", "sooryavanshi", "sharma", "sharmaa", "verma", "varma", "kohli", "kholi", "abab", "babab", "aaaa", "aaa", "a", "b", "ab", "ba", "abcabcabc", "cabcab", "mississippi", "misisipi"]


def _words():
    draw = random.Random(6)
    return WORDS + ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 12))) for _ in range(200)]


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_is_that_of_matching_blocks(spark):
    pairs = [(a, b) for a, b in itertools.product(_words(), repeat=2)][::7]
    got = similar.ratio(spark.createDataFrame(pairs, "x string, y string"), "x", "y", "r").collect()
    assert all(abs(r.r - _ratio(r.x, r.y)) < 1e-12 for r in got) and len(got) == len(pairs)


def test_the_join_finds_all_similar_words(spark):
    words = _words()
    draw = random.Random(2)
    asked = words[::2] + [w[:k] + draw.choice("abcdxy") + w[k + draw.randint(0, 1) :] for w in words[:120] for k in [draw.randint(0, len(w))]]
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, "", None]], "word string")
    for least in (0.82, 0.9):
        got = {(r.word, r.other) for r in similar.similar_words(frame(asked), frame(words), least).collect()}
        assert got == {(a, b) for a in set(asked) for b in set(words) if _ratio(a, b) >= least}
    with pytest.raises(ValueError):
        similar.similar_words(frame(asked), frame(words), 0.7)


def _plain(query, names):
    """One question against all names, as a loop."""
    norm = lambda s: "".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split()
    asked, scores = norm(query), {}
    for name in names if len(asked) >= 2 else []:
        words = norm(name)
        if len(words) < 2:
            continue
        first = (1.0 if words[0] == asked[0][0] else 0.0) if len(words[0]) == 1 else _ratio(asked[0], words[0])
        last = _ratio(asked[-1], words[-1])
        if last >= 0.82 and first >= 0.34:
            scores[name] = last * 80 + first * 20
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    clear = len(ranked) == 1 or len(ranked) > 1 and ranked[0][1] >= ranked[1][1] + 16
    return ranked[0][0] if clear else None, "|".join(n for n, _ in ranked[:8]) or None


def test_misspelt_names_are_told_as_by_a_loop(spark):
    names = ["V Sooryavanshi", "Vaibhav Suryavanshi", "Rohit Sharma", "R Sharma", "Mohit Sharma", "Virat Kohli", "Single", "A B de Villiers", "O'Neil K."]
    asked = ["vaibhav sooryavanshy", "rohit sharmaa", "virat kohly", "virat kholi", "single", "a devilliers", "ab villiers", "", None, "x y", "o neil kk", "zzz sharma"]
    players = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "player string")
    questions = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {r.query: (r.player, r.candidates) for r in similar.told(similar.fuzzy(questions, players), questions).collect()}
    assert got == {q: _plain(q, names) for q in asked}
    assert got["vaibhav sooryavanshy"][0] == "V Sooryavanshi" or got["vaibhav sooryavanshy"][1]


def test_clear_aliases_come_before_similar_names(spark):
    names = [("Virat Kohli",), ("Rohit Sharma",), ("Mohit Sharma",), ("Ishant Sharma",)]
    players = spark.createDataFrame(names, "player string")
    index, activity = identity.aliases(players), spark.createDataFrame([], "player string, activity long")
    questions = spark.createDataFrame([("kohli",), ("virat kohlii",), ("sharma",), ("qqq",), ("rohitt sharm",)], "query string")
    got = {r.query: r.player for r in similar.resolved_or_similar(questions, identity.resolved(questions, index, activity), players).collect()}
    assert got == {"kohli": "Virat Kohli", "virat kohlii": "Virat Kohli", "sharma": None, "qqq": None, "rohitt sharm": None}


def test_a_text_is_searched_for_its_first_two_words_only(spark):
    texts = ["One two three", "one", "", None, "  --One,,TWO!", "İstanbul x", "été a1 b2", "a" * 5000, "x\n\ny z"]
    from pitchframe.name_queries import two_words

    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [r.w for r in frame.select(identity.norm(F.col("text")).alias("w")).collect()]
    got = {(r.f, r.l) for r in two_words(frame).collect()}
    assert got == {tuple(w.split(" ")[:2]) for w in words if len(w.split(" ")) > 1}
    plan = two_words(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1


def test_words_that_share_pairs_but_not_enough_letters_are_not_compared(spark, monkeypatch):
    asked, words = ["abcdef", "abcdgh", "abcdij"], ["abcdkl", "abcdmn", "abcdef"]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    seen, real = [], similar.ratio
    monkeypatch.setattr(similar, "ratio", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    assert [r.other for r in similar.similar_words(frame(asked), frame(words)).collect()] == ["abcdef"] and seen == [1]


def test_pairs_compared_at_once_are_those_compared_one_by_one():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.choice([1, 2, 3, 5, 8, 13, 39, 40, 41, 60])))
    pairs = [(word(), word()) for _ in range(3000)] + [("aab", "ab"), ("abab", "baba"), ("abcabc", "cabcab")]
    a, b = (pd.Series(x, index=range(7, 7 + len(pairs))) for x in zip(*pairs, strict=True))
    assert similar.matched_each(a, b).tolist() == [similar.matched(u, v) for u, v in pairs]
    assert similar.matched_each(a[:0], b[:0]).tolist() == []


def test_first_words_without_letters_in_common_are_not_compared(spark, monkeypatch):
    compared, real = [], similar.ratio
    monkeypatch.setattr(similar, "ratio", lambda pairs, a, b, name: (compared.append((name, pairs)), real(pairs, a, b, name))[1])
    asked = spark.createDataFrame([("abcd smith",), ("b smith",)], "query string")
    players = spark.createDataFrame([("wxyz smith",), ("abce smith",), ("a smith",), ("b smith",)], "player string")
    got = {(r.query, r.player) for r in similar.fuzzy(asked, players).collect()}
    assert got == {("abcd smith", "abce smith"), ("abcd smith", "a smith"), ("b smith", "b smith"), ("b smith", "abce smith")}
    assert {(r["first"], r.initial) for name, pairs in compared if name == "like" for r in pairs.collect()} == {("abcd", "abce"), ("b", "abce")}


def test_documents_are_read_once(spark):
    from pitchframe import name_queries

    plan = name_queries.resolve_fuzzy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    relations = [line.strip(" :+-") for line in plan.splitlines() if "Relation [" in line]
    assert len(relations) > 1 and all(line.startswith("InMemoryRelation") for line in relations)
