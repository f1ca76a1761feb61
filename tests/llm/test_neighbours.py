"""Nearest neighbours against brute force: structure, ties, repeats, lengths, vectors that take no part."""

import math

import numpy as np

from pitchframe.llm import neighbours
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, rank int, query_id string, score double"  # the last three clash


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], SCHEMA)


def _brute(rows, asks, k):
    good = {}
    for i, v in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(v, good.get(i, v))
    out = {}
    for q, a in good.items():
        if asks(q):
            near = sorted((math.dist(a, b), i) for i, b in good.items() if i != q and len(b) == len(a))
            out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return {q: v for q, v in out.items() if v}


def _found(frame, asks, k):
    out = {}
    for r in neighbours.nearest(frame, asks, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_odd_vectors_ties_and_lengths(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)]  # many ties
    rows += [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 2.0]), (64, [float("nan"), 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (7, [2.0, 1.0, 1.0]), (7, [2.0, 1.0, 1.0]), (8, [-1.0, 0.0, 1.0])]  # repeated ids
    rows += [(70 + i, [float(i), 1.0]) for i in range(4)] + [(80, [5.0] * 7)]  # other lengths
    got, want = _found(_frame(spark, rows), F.col("vec_id") % 2 == 0, 10), _brute(rows, lambda q: q % 2 == 0, 10)
    assert {q: [x[:2] for x in v] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_fewer_rows_than_asked_for_and_none(spark):
    assert _found(_frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]), F.col("vec_id") == 0, 10) == {0: [(1, 1, 1.0)]}
    assert neighbours.nearest(_frame(spark, []), F.lit(True)).count() == 0
    assert neighbours.nearest(_frame(spark, [(0, [1.0])]), F.lit(True)).count() == 0


def test_a_common_vector_hides_no_neighbour(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [1.0] * 16) for i in range(1500)] + [(1500 + i, draw.normal(size=16).tolist()) for i in range(1500)]
    rows += [(5000, draw.normal(size=16).tolist())] * 30  # one id, many rows
    got, want = _found(_frame(spark, rows), F.col("vec_id") % 100 == 0, 10), _brute(rows, lambda q: q % 100 == 0, 10)
    hits = [len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want if q >= 1500]
    assert sum(hits) >= 9 * len(hits)
    assert all(got[q] == want[q] for q in want if q < 1500)


def test_recall_does_not_fall_with_the_number_of_rows(spark):
    draw = np.random.default_rng(4)
    for n in (1000, 8000):
        x = draw.normal(size=(n, 32)).astype(np.float32).astype(float)
        rows = list(enumerate(x.tolist()))
        got = _found(_frame(spark, rows), F.col("vec_id") % 100 == 0, 10)
        hits = 0
        for q, found in got.items():
            far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            hits += len({f[1] for f in found} & set(np.argsort(far)[1:11].tolist()))
        assert hits >= 9 * len(got) and len(got) == n // 100
