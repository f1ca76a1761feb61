"""Near-dedup by shingle sets against brute force."""

import random

from pitchframe.llm import simhash

DOCS = "doc_id long, text string"


def _components(rows, similarity=0.8, shingle=5):
    def of(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()

    sets = {d: of(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            small, large = sorted((len(x), len(y)))
            if small >= similarity * large - 1e-9 and root(a) != root(b):
                if (len(x & y) / len(x | y) if x | y else 1.0) >= similarity:
                    p, q = sorted((root(a), root(b)))
                    label[q] = p
    return {d: root(d) for d in ids}


def _found(spark, rows, **kept):
    got = simhash.similar_documents(spark.createDataFrame(rows, DOCS), **kept).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.component_id for r in got}


def _edited(draw, words, edits):
    """``words`` with ``edits`` words, far apart, replaced by new ones: each replaces five shingles by others."""
    out = list(words)
    step = len(words) // (edits + 1)
    for k in range(edits):
        out[(k + 1) * step] = f"new{draw.random()}"
    return out


def test_pairs_at_the_limit_are_all_found(spark):
    draw = random.Random(1)
    rows = []
    for n in range(400):
        words = [f"w{draw.randrange(20_000)}" for _ in range(500)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(_edited(draw, words, 11)))]  # 441 of 551: 0.8004
    assert _found(spark, rows) == {d: d - d % 2 for d, _ in rows}


def test_components_are_brute_force(spark):
    draw = random.Random(2)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, "a b c d e"), (5, "a b c d e f")]
    for _ in range(40):  # chains, whose ends are less alike than neighbours
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([12, 60, 200]))]
        for _ in range(5):
            rows.append((len(rows), f"{line}\n{' '.join(words)}" if draw.random() < 0.5 else " ".join(words)))
            words = _edited(draw, words, draw.choice([1, 2, 4]))
    base = [f"v{i}" for i in range(150)]
    rows += [(len(rows) + i, " ".join(_edited(draw, base, draw.choice([1, 2, 3])))) for i in range(80)]  # one large group
    want = _components(rows)
    assert _found(spark, rows) == want
    assert _found(spark, rows, stars=0) == want


def test_repeated_lines_count_once(spark):
    draw = random.Random(3)
    rows = []
    for times in (1, 3, 10, 30):
        words = [f"w{draw.randrange(20_000)}" for _ in range(288)]
        line = " ".join(f"end{times}x{i}" for i in range(12))
        rows += [(len(rows), " ".join(words) + "\n" + line), (len(rows) + 1, " ".join(words) + f"\n{line}" * (times + 1))]
    # Of few shingles, most repeated: sets less than 0.8 alike whose counted fingerprints agree.
    rows += [(100 + i, "la " * 500 + f"only{i} these{i} few{i} words{i} differ{i}") for i in range(2)]
    want = _components(rows)
    assert [want[d] for d, _ in rows] == [0, 0, 2, 2, 4, 4, 6, 6, 100, 101]
    assert _found(spark, rows) == want


def test_odd_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, row long, size int, keys string, label long, id long, w0 long"
    rows = [(None, text), (None, None), (4, text + " tail"), (4, text + " tail"), (9, ""), (2, None), (7, "x " * 50_000)]
    got = simhash.similar_documents(spark.createDataFrame([(*r, 1, 1, "k", 1, 1, 1) for r in rows], schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == sorted(
        [(True, 0, 4), (True, 0, 2), (False, 4, 4), (False, 4, 4), (False, 9, 2), (False, 2, 2), (False, 7, 7)]
    )
    alone = simhash.similar_documents(spark.createDataFrame([(None, "only one")], DOCS)).collect()
    assert [r.component_id for r in alone] == [None]
    assert simhash.similar_documents(spark.createDataFrame([], DOCS)).count() == 0
    narrow = spark.createDataFrame([(3, "a b"), (1, "A B")], "doc_id int, text string")
    assert {r.component_id for r in simhash.similar_documents(narrow).collect()} == {1}


def test_near_duplicates_of_odd_rows(spark):
    schema = "doc_id long, text string, id long, n long, label long, choice int, key long"
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (5, ""), (6, None)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (3, 3), (3, 3), (5, 5), (6, 5)]


def test_recall_of_pairs_of_any_size(spark):
    draw = random.Random(9)
    rows = []
    for n in (5, 9, 20, 50, 120, 400, 2000):
        for _ in range(25):
            words = [f"v{draw.randrange(30_000)}" for _ in range(n + 4)]
            more = [f"n{draw.random()}" for _ in range(n // 4)]  # n of n + n // 4 shingles: 0.8 or a little more
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + more))]
    assert _found(spark, rows) == {d: d - d % 2 for d, _ in rows}
