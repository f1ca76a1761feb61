"""Fingerprints: likeness against the sets themselves, any script, edges."""

import hashlib
import random

import numpy as np
import pytest

from pitchframe.llm import iblt

SCHEMA = "doc_id long, text string, part int, n_chars string, follows boolean"  # the last three clash with names used inside


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", True) for d, t in rows], SCHEMA)


def _pieces(text):
    """Paragraphs by going through the text, one code point after the other."""
    out, start, line = set(), 0, 0
    for i, c in enumerate(text):
        end = c == "\n" or i == len(text) - 1
        if c != "\n" and i - line >= iblt.REACH - 1:
            h = sum(ord(text[i - k]) * (0x9E3779B1 * (2 * k + 1) & 0xFFFFFFFF) for k in range(iblt.REACH)) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            end |= (h >> 12) % iblt.EVERY == 0
        if end:
            out.add(text[start : i + 1].strip())
            start = i + 1
        if c == "\n":
            line = i + 1
    return out - {""}


def _share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_that_of_the_paragraphs(spark):
    draw = random.Random(5)
    words = ["alpha", "бета", "γάμμα", "デルタ", "zeta!", "eta.", "|", "x"]
    rows = [(3 * i, "".join(draw.choice(words) + draw.choice([" ", " ", "\n"]) for _ in range(draw.choice([0, 1, 5, 80, 700])))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, rows[5][1]), (503, "y" * 5000), (504, "\n\n \n")]
    got = {r.doc_id: r for r in iblt.fingerprints(_docs(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (d, _) in enumerate(rows):
        after = texts[(k + 1) % len(rows)]
        n = len(texts[k]) // 4
        changed = texts[k][: len(texts[k]) - n] + after[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(_share(_pieces(texts[k]), _pieces(changed)))
        assert r.near_next == pytest.approx(_share(_pieces(texts[k]), _pieces(after)))
    assert got[502].fingerprint == got[15].fingerprint and got[500].fingerprint == got[501].fingerprint == got[504].fingerprint


@pytest.mark.parametrize("letters", ["абвгдежзийк", "日本語文字列処理学習", "abcdefghij", "😀😁😂🤣😃"])
def test_a_long_line_of_any_script_has_many_paragraphs(letters):
    draw = random.Random(6)
    text = "".join(draw.choice(letters) for _ in range(4000))
    other = text[:3000] + "".join(draw.choice(letters) for _ in range(1000))
    sets = [iblt.digests(text), iblt.digests(other)]
    found = iblt.likeness(sets[:1], sets[1:], iblt.sketched(sets[:1]).minus(iblt.sketched(sets[1:])))
    assert len(sets[0]) > 30 and 0.4 < found[0] < 0.75


def test_peeling_recovers_the_differing_digests():
    draw = np.random.default_rng(7)
    common, mine, theirs = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (500, 5, 3))
    a, b = np.concatenate([common, mine]), np.concatenate([common, theirs])
    owner, keys, sign, empty = iblt.sketched([a], 48).minus(iblt.sketched([b], 48)).peel()
    assert empty.all() and set(keys[sign == 1].tolist()) == set(mine.tolist()) and set(keys[sign == -1].tolist()) == set(theirs.tolist())


def test_odd_tables(spark):
    assert iblt.fingerprints(_docs(spark, [])).count() == 0
    (one,) = iblt.fingerprints(_docs(spark, [(7, "a b c d")])).collect()
    assert (one.near_next, one.n_chars) == (1.0, 7)  # its own successor
    got = iblt.fingerprints(_docs(spark, [(None, "a"), (4, "b"), (4, "b"), (4, "c")])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 1), (4, 1), (4, 1), (4, 1)]
