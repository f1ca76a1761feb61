"""Vector codes: the heaps' rounds against plain Lloyd rounds over all parts, SQL, ties and odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from compare import difference, duck

from pitchframe.llm import codes, queries

SF = "/root/testdata/sf0.001"


def _plain(rows, rounds=codes.ROUNDS):
    """(vec_id, code, error) and the codebooks, by looking at every part against every entry."""
    rows = sorted(((i, [math.floor(4096 * x) for x in v]) for i, v in rows), key=lambda r: (r[0] is None, r))
    size = len(rows[0][1]) // codes.PARTS
    x = np.array([v[: codes.PARTS * size] for _, v in rows], np.int64).reshape(len(rows), codes.PARTS, size)
    books = x[:16].transpose(1, 0, 2).copy()

    def nearest():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(codes.PARTS):
            for e in set(at[:, p].tolist()):
                mine = x[at[:, p] == e, p]
                books[p, e] = mine.sum(axis=0) // len(mine)
    at, far = nearest()
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in c), int(f.sum())) for (i, _), c, f in zip(rows, at, far, strict=True)), key=str), digest


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label string, code int").repartition(parts)


def _got(spark, rows, **more):
    found, books = codes.compress(_frame(spark, rows, **more))
    return sorted(((r.vec_id, r.code, r.error) for r in found.collect()), key=str), books and books.digest()


def test_rows_are_those_of_sql(spark):
    assert difference(spark, duck(SF), queries.QUERIES["op13_vector_codes"], queries.ORACLES["op13_vector_codes"], SF) is None


@pytest.mark.parametrize("kind", ["clusters", "noise", "grid"])
def test_rounds_are_those_of_plain_lloyd(spark, kind):
    random = np.random.default_rng(5)
    x = {
        "clusters": random.normal(size=(24, 32))[random.integers(0, 24, 700)] + 0.05 * random.normal(size=(700, 32)),
        "noise": random.normal(size=(300, 16)),
        "grid": random.integers(-1, 2, size=(500, 8)).astype(float),  # many equal parts and equal distances
    }[kind]
    rows = [(int(i), v.tolist()) for i, v in zip(random.permutation(len(x)), x, strict=True)]
    assert _got(spark, rows) == _plain(rows)


def test_few_parts_are_scanned_again_where_there_are_clusters():
    """Parts whose slack the drift has not reached stay where they are, unscanned."""
    random = np.random.default_rng(9)
    centres = random.normal(size=(16, 32)) * 4
    x = np.floor(4096 * (centres[np.arange(4000) % 16] + 0.05 * random.normal(size=(4000, 32)))).astype(np.int64).reshape(4000, 8, 4)
    books, heaps, looked = codes.Codebooks(x[:16].reshape(16, -1)), codes.Heaps(4000), []
    change, scan = heaps.first(x, books), codes.Codebooks.scanned
    for _ in range(6):
        books.moved(change)
        seen = []
        books.scanned = lambda parts, p: seen.append(len(parts)) or scan(books, parts, p)  # noqa: B023
        change = heaps.renew(x, books)
        looked.append(sum(seen))
    assert looked[-1] == 0 and sum(looked) < 0.2 * 6 * x.shape[0] * codes.PARTS


def test_odd_vectors(spark):
    good = [(i, [math.sin(i * 7 + j) for j in range(20)]) for i in range(30)]  # the last four components fill no part
    bad = [(100, None), (101, [1.0] * 19 + [None]), (102, [math.nan] + [1.0] * 19), (103, [math.inf] * 20), (104, [1.0] * 8), (105, [])]
    assert _got(spark, good + bad) == _plain(good)
    ties = [*good[:20], *good[:20], (None, good[3][1]), (5, [0.0] * 20)]
    assert _got(spark, ties) == _plain(ties)
    few = [(3, [0.5] * 8), (1, [0.5] * 8), (2, [1e30] * 8)]
    found, _ = _got(spark, few)
    assert [r[:2] for r in found] == [(1, "00" * 8), (2, "01" * 8), (3, "00" * 8)] and all(r[2] == 0 for r in found)
    assert _got(spark, [(1, [])]) == ([(1, "00" * 8, 0)], hashlib.sha256(b"").hexdigest())
    assert _got(spark, bad[:4]) == ([], None)


def test_label_errors(spark):
    rows = spark.createDataFrame([(i, "00", i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(50)], "vec_id long, code string, error long, label string")
    got = codes.with_label_error(rows).collect()
    want = {k: sum(r.error for r in got if r.label == k) for k in (None, "a", "b")}
    assert len(got) == 50 and all(r.label_error == want[r.label] for r in got)
    assert codes.with_label_error(rows.limit(0)).count() == 0
