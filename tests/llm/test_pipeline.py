"""The pipeline's stages on odd rows, and the whole of it against steps carried out one document after the other."""

import random

import corpus_pipeline
import pytest
from test_similar import _components

from pitchframe.llm import language, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, languages int, stats int, spans int, label int, row int"
EXTRA = (0.5, "x", 1, 2, 3, 4, 5)
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(8)
    good = ["the river runs past a quiet town and its people walk home", "a dog sleeps near the warm stove while rain falls outside"]
    words = sorted({w for g in good for w in g.split()})
    rows = []
    for i in range(120):
        base = " ".join(draw.choice(words) for _ in range(draw.choice([8, 40, 200])))
        rows.append((i, f"{base}. " + draw.choice(good), "en" if i % 3 else "de", "s", 10, *EXTRA))
    rows += [(200 + i, "### $$$ %%% &&& " * 30 + f"q{i}", "en", "s", 10, *EXTRA) for i in range(40)]
    rows += [(300, rows[7][1], "en", "s", 10, *EXTRA), (301, rows[9][1] + " tail", "en", "s", 10, *EXTRA), (302, None, None, None, None, *EXTRA), (303, "", "en", "s", 0, *EXTRA)]
    rows += [(304, f"{rows[30][1]} write to jo.doe@example.org", "en", "s", 10, *EXTRA), (305, "word " * 30_000, "en", "s", 10, *EXTRA)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 0 if d in range(200, 240) else 1, 0) for d, *_ in rows if d % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_document_after_the_other(spark, folder):
    spark.conf.set(pii.KEY, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    # Language: documents without a letter go.
    kept = STAGES["language ID"](spark, docs, folder)
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    # Quality: those go that the model of the labelled rows scores below the limit.
    model = quality.fit(quality.labelled(quality.measured(kept, "doc_id"), spark.read.parquet(f"{folder}/labels.parquet")))
    want = [r.doc_id for r in kept.collect() if model.score([quality.statistics(r.text)])[0] >= corpus_pipeline.LEAST_QUALITY]
    kept = STAGES["quality classifier"](spark, kept, folder)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert not {200, 210, 239} & set(want) and len(want) > 100
    # Near copies: one of each component stays.
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    of = _components(rows)
    kept = STAGES["SimHash near-dedup"](spark, kept, folder)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted({of[d] for d, _ in rows})
    # Personal data.
    p = pii.Pseudonyms("test")
    want = {r.doc_id: pii.pseudonymised(p, r.text, {})[0] for r in kept.collect()}
    kept = STAGES["PII"](spark, kept, folder)
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    # Packing: each document once, gapless.
    pieces = STAGES["packing"](spark, kept, folder).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for d in want:
        assert sum(r.length for r in pieces if r.doc_id == d) == next(r.doc_tokens for r in pieces if r.doc_id == d)
    whole = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == set(want)
    spark.conf.unset(pii.KEY)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_empty_tables_and_null_ids(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
    odd = spark.createDataFrame([(None, "a quiet town and its people walk home " * 3, None, None, None, *EXTRA), (None, "a quiet town and its people walk home " * 3, None, None, None, *EXTRA), (1, None, None, None, None, *EXTRA)], SCHEMA)
    got = STAGES[name](spark, odd, folder).collect()
    assert all(r.doc_id is None or r.doc_id == 1 for r in got)
    if name in ("language ID", "SimHash near-dedup", "PII"):  # of equal rows one stays when copies go
        assert sum(r.doc_id is None for r in got) == (1 if name == "SimHash near-dedup" else 2)
    assert language.UNDETERMINED not in {r.lang_pred for r in got if "lang_pred" in r}


def test_copies_go_by_row_and_not_by_id(spark, folder):
    draw = random.Random(3)
    a, b, c, d = (" ".join(draw.choice("river town dog stove rain walk past quiet".split()) + str(draw.randrange(99)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, f"{a} tail"), (5, b), (9, c), (9, c), (None, b), (None, d), (None, d), (7, ""), (8, ""), (3, f"{d} tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *EXTRA) for i, t in rows], SCHEMA)
    got = STAGES["SimHash near-dedup"](spark, docs.repartition(4), folder)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in got.where("text <> ''").collect())
    assert kept == sorted([(1, a), (5, b), (9, c), (3, f"{d} tail")])
