"""Importance resampling: weights and ranks against plain Python, its SQL, ties and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from compare import difference, duck
from pyspark.sql import functions as F

from pitchframe.llm import queries, resampling

SF = "/root/testdata/sf0.001"


def _plain(docs, target, runs=1, share=10, of=100, n=10000):
    def features(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(resampling.WORD, text)
        return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) % n for k in range(1, runs + 1) for i in range(len(found) - k + 1)]

    mine, theirs = [(d, *features(t)) for d, t in docs], Counter(b for t in target for b in features(t)[1])
    s = Counter(b for _, _, f in mine for b in f)
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (s.total() + n) / ((s[b] + 1) * (theirs.total() + n))))
    rows = []
    for d, words, f in mine:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {r[0]: k + 1 for k, r in enumerate(able[: share * len(able) // of])}
    return sorted(((*r[:4], ranks.get(r[0])) for r in rows), key=str)


def _got(found):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=str)


def test_rows_are_those_of_sql_and_of_plain_python(spark):
    assert difference(spark, duck(SF), queries.QUERIES["op12_resampling"], queries.ORACLES["op12_resampling"], SF) is None
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _got(queries.QUERIES["op12_resampling"](spark, SF)) == _plain(docs, target)


def test_runs_of_two_words_and_other_shares(spark):
    docs = [(i, f"Word{i} the é{i % 3} " * (5 + i)) for i in range(40)]
    target = ["the é1 word3", None, "word7 the", ""]
    frame, theirs = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for share in (0, 35, 100):
        assert _got(resampling.resample(frame, theirs, share=share, runs=2)) == _plain(docs, target, runs=2, share=share)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "a " * 30), (4, "b " * 100_000), (5, "!!! ???"), (6, "Ünï çødé 中文 " * 10), (7, "one two")]
    frame = spark.createDataFrame([(d, t, "s", 3) for d, t in docs], "doc_id long, text string, score string, features int")
    theirs = spark.createDataFrame([("a 中文",)], "text string")
    assert _got(resampling.resample(frame, theirs, share=50)) == _plain(docs, ["a 中文"], share=50)
    assert _got(resampling.resample(frame, theirs.limit(0))) == _plain(docs, [])
    assert resampling.resample(frame.limit(0), theirs).count() == 0


def test_ranks_of_ties_and_repeated_rows(spark):
    scored = spark.range(3000).select(F.expr("id div 2").alias("doc_id"), (F.lit(5000) - F.col("id") % 7 * 900).alias("score"), F.lit(20).alias("n_words"))
    got = [(r["rank"], -r.score, r.doc_id) for r in resampling.ranked(scored, 70, 100).collect()]
    drawn = sorted(x for x in got if x[0])
    assert [x[0] for x in drawn] == list(range(1, 2101))
    assert [x[1:] for x in drawn] == sorted(x[1:] for x in got)[:2100]
