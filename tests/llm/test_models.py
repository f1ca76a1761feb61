"""Quality, language and PII against brute force or held-out rows, and what they do with odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from pitchframe.llm import language, pii, quality, queries

SF = "/root/testdata/sf0.01"


def _auc(scores, ones):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.array(scores)[order]
    for v in np.unique(values):
        at = np.flatnonzero(values == v)
        ranks[order[at]] = at.mean() + 1
    ones = np.array(ones, bool)
    n1, n0 = ones.sum(), (~ones).sum()
    return (ranks[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# --- quality ------------------------------------------------------------------------------------------------------------
def test_pooled_is_isotonic_regression():
    draw = random.Random(1)
    for n in (1, 2, 7, 40):
        counts = [draw.randrange(1, 9) for _ in range(n)]
        ones = [draw.randrange(c + 1) for c in counts]
        edges, values = quality.pooled([float(i) for i in range(n)], ones, counts)
        got = np.interp(range(n), edges, values)
        # The minimax formula: the largest of the smallest means of runs that hold i.
        mean = lambda a, b: sum(ones[a : b + 1]) / sum(counts[a : b + 1])
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_weights_solve_the_ridge_equations(spark):
    draw = np.random.default_rng(2)
    stats = draw.normal(size=(300, len(quality.STATISTICS)))
    label = (stats[:, 0] + 0.3 * draw.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label, strict=True)] + [(stats[0].tolist(), None)], "stats array<double>, label int")
    model = quality.fit(rows.repartition(5), features=32)
    x = model.mapped(stats)
    penalty = np.eye(33)
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + penalty, x.T @ label), atol=1e-6)
    assert _auc(model.score(stats), label) > 0.85


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op7_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    assert _auc([r.score for r in held], [labels[r.doc_id] == 1 for r in held]) > 0.9


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n ", "a", "a", "word " * 60_000, "😀" * 50]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, stats string")
    stats = quality.measured(docs, "doc_id")
    none = quality.fit(quality.labelled(stats, spark.createDataFrame([], "doc_id long, quality int")))
    assert {r.score for r in quality.score(stats, none, "doc_id").collect()} == {0.5}
    same = spark.createDataFrame([(i, 1) for i in range(7)], "doc_id long, quality int")
    one = quality.fit(quality.labelled(stats, same))
    assert {r.score for r in quality.score(stats, one, "doc_id").collect()} == {1.0}
    got = quality.predict(docs, one, *docs.columns, name="fresh").collect()
    assert len(got) == 7 and got[0]["score"] == 0.5
    with pytest.raises(ValueError):
        quality.predict(docs, one, *docs.columns)
    assert quality.predict(docs.limit(0), one, "doc_id").count() == 0
    assert quality.statistics("") == quality.statistics("") and all(map(math.isfinite, quality.statistics("")))


# --- language -----------------------------------------------------------------------------------------------------------
def _learned(spark):
    rows = [("der hund und die katze schlafen heute nicht " * 5, "de"), ("the dog and the cat do not sleep today " * 5, "en"), ("ꙮ𐐀𐐁𐐂𐐃 𐐄𐐅𐐆𐐇 " * 9, "wide"), (None, "xx"), ("no language given", None)]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_mixtures_are_expectation_maximisation():
    draw = np.random.default_rng(3)
    chances = draw.dirichlet(np.full(50, 0.2), 3).T.astype(np.float32)
    chances = (chances + 1e-4) / (chances + 1e-4).sum(axis=0)
    chances = np.vstack([chances, np.full((language.BUCKETS - 50, 3), 1e-9, np.float32)])
    grams = np.concatenate([draw.choice(50, 300, p=(p := chances[:50, k].astype(float)) / p.sum()) for k in (0, 2)])
    found = language.mixtures(chances, grams, np.array([600]))[0]
    shares = np.full(3, 1 / 3)
    for _ in range(400):  # all three languages, to convergence
        joint = chances[grams] * shares
        shares = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    assert found[1] == 0 and abs(found[0] - shares[0]) < 0.05 and abs(found[2] - shares[2]) < 0.05
    single = language.mixtures(chances, grams[:300], np.array([300]))[0]
    assert single.tolist() == [1.0, 0.0, 0.0]


def test_language_of_odd_rows(spark):
    model = _learned(spark)
    assert model.names == ("de", "en", "wide")
    texts = [None, "", "123 !?", "und der hund", "the dog sleeps", "𐐀𐐁𐐂 𐐄𐐅𐐆", "the dog sleeps", "der hund und die katze schlafen the dog and the cat do not sleep " * 3000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = sorted(language.predict(docs, model, *docs.columns, names=("a", "b", "c")).collect())
    assert [r.a for r in got[:7]] == ["und", "und", "und", "de", "en", "wide", "en"]
    assert [r.b for r in got[:3]] == [0.0] * 3 and got[4][3:] == got[6][3:] and set(got[7].c) == {"de", "en"}
    with pytest.raises(ValueError):
        language.predict(docs, model, *docs.columns)
    assert language.predict(docs.limit(0), model, "doc_id").count() == 0
    nothing = language.learn(docs.select("text").withColumn("lang", docs.text.substr(1, 0)).limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing, "doc_id").collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language"](spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != language.UNDETERMINED]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


# --- PII ----------------------------------------------------------------------------------------------------------------
def test_pseudonyms_are_permutations():
    p = pii.Pseudonyms("key")
    for size in (2, 3, 10, 97, 1000, 4096):
        assert sorted(p.permuted(v, size, "t") for v in range(size)) == list(range(size))
    assert len({p.digits(f"{v:04d}", "number") for v in range(10_000)}) == 10_000
    assert len({pii._date(p, f"{1900 + d // 366}-{1 + d % 12:02d}-{1 + d % 28:02d}") for d in range(5000)}) == len({(1900 + d // 366, 1 + d % 12, 1 + d % 28) for d in range(5000)})
    assert pii.Pseudonyms("key").digits("123456789", "n") == p.digits("123456789", "n") != pii.Pseudonyms("other").digits("123456789", "n")


def test_pseudonyms_keep_formats_and_links():
    p, known = pii.Pseudonyms("key"), {}
    text = "card 4111 1111 1111 1111, iban DE89370400440532013000, born 1980-02-29, mail jo.doe@example.org, ip 10.1.2.3, 4111 1111 1111 1111"
    new, spans = pii.pseudonymised(p, text, known)
    kinds = [s["kind"] for s in spans]
    assert kinds == ["card", "iban", "date", "email", "address4", "card"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", new)
    assert len(cards) == 2 and cards[0] == cards[1] and cards[0] != "4111 1111 1111 1111" and len(cards[0]) == 19
    digits = cards[0].replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1])
    (iban,) = re.findall(r"DE\d{20}", new)
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4]
    assert pii.pseudonymised(p, "nothing to hide, 12 apples", known) == ("nothing to hide, 12 apples", [])


def test_pii_of_odd_rows(spark):
    texts = [None, "", "plain words", "mail jo@example.org", "mail jo@example.org", "x " * 100_000 + "jo@example.org"]
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, kind string, `a b` int")
    got = sorted(pii.pseudonymise(docs, "key", spans="found").collect())
    assert [(r.text, len(r.found)) for r in got[:3]] == [(None, 0), ("", 0), ("plain words", 0)]
    assert got[3].text == got[4].text != texts[3] and got[5].text.endswith(got[3].text[5:]) and all(r.kind == "kept" for r in got)
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "key", spans="kind")
    assert pii.pseudonymise(docs.limit(0), "key").count() == 0


def test_a_session_without_a_key_gets_a_secret_one(spark):
    spark.conf.unset(pii.KEY)
    first = pii.session_key(spark)
    assert len(first) == 64 and pii.session_key(spark) == first
    spark.conf.set(pii.KEY, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY)
