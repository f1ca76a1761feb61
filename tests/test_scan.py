"""Running sums over ranges against a loop over all balls, with one player holding half of them, null keys and odd match ids."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchframe.functions.expr import COUNTS
from pitchframe.operators import decay, evaluate, evidence, scan
from pitchframe.sources.adapter import deliveries


@pytest.fixture(scope="module")
def balls(spark):
    """Half the balls are one batter's and one bowler's; some have no batter; matches of a season span several blocks and spans."""
    rows = deliveries(spark, "/root/testdata/sf0.001").where("season_id < 1997")
    half = F.col("source_row_number") % 2 == 0
    rows = rows.withColumns({"batter": F.when(half, "Hot").when(F.col("source_row_number") % 13 == 0, None).otherwise(F.col("batter")), "bowler": F.when(half, "Hot").otherwise(F.col("bowler"))})
    return rows.withColumn("match_id", F.col("match_id") + (F.col("match_id") % 100 % 3) * 5000).cache()


def test_sums_in_front_are_those_of_a_loop(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(3), draw.choice([-3, 0, 7, 8, 4095, 4096, 9000, 123456]), k, draw.randrange(9)) for k in range(600)]
    frame = spark.createDataFrame(rows, "key string, season_id int, match_id long, at int, v int")
    got = {r["at"]: (r.total, r.n) for r in scan.running(frame, ["key"], ("season_id", "match_id", "at"), {"total": F.col("v"), "n": F.lit(1)}).collect()}
    seen, want = defaultdict(list), {}
    for key, season, match, at, v in sorted(rows, key=lambda r: r[1:4]):
        want[at] = (sum(seen[key]), len(seen[key]))
        seen[key].append(v)
    assert got == want
    assert scan.running(frame.limit(0), ["key"], ("season_id", "match_id", "at"), {"total": F.col("v")}).count() == 0


def _ordered(rows, *extra):
    return sorted(rows.select(*evidence.CHRONOLOGY, *extra).collect(), key=lambda r: tuple(r)[: len(evidence.CHRONOLOGY)])


def test_histories_are_those_of_a_loop(spark, balls):
    contexts = ("global", "batter", "batter_bowler", "season", "legal_phase")
    rows = evidence.labelled(balls)
    names = [f"{c}_{n}" for c in contexts for n in COUNTS]
    keys = {c: evidence.CONTEXTS[c] for c in contexts}
    fields = list(dict.fromkeys(["batter", "bowler", "season_id", "legal_phase", *COUNTS]))
    got = _ordered(evidence.histories(rows, *contexts), "batter", "bowler", "legal_phase", *COUNTS, *names)
    assert len(got) == balls.count() > 500 and set(fields) <= set(got[0].asDict()) and "_block" not in evidence.histories(rows, "global").columns
    seen = defaultdict(Counter)
    for r in got:
        for c in contexts:
            key = (c, *(r[k] for k in keys[c]))
            known = all(k is not None for k in key)
            assert [r[f"{c}_{n}"] for n in COUNTS] == ([seen[key][n] for n in COUNTS] if known else [0] * 7)
            seen[key].update({n: r[n] for n in COUNTS})


def test_careers_and_steps_are_those_of_a_loop(spark, balls):
    runs = defaultdict(int)
    by_place = {tuple(r)[:6]: (r.batter, r.batter_runs) for r in _ordered(balls, "batter", "batter_runs")}
    for r in _ordered(evidence.batter_history(balls), "career_runs"):
        batter, n = by_place[tuple(r)[:6]]
        assert r.career_runs == runs[batter]
        runs[batter] += n
    steps = _ordered(decay.numbered(evidence.labelled(balls)), "step")
    assert [r.step for r in steps] == list(range(len(steps)))


@pytest.mark.parametrize("rate", [1.0, 0.995])
def test_decayed_counts_are_those_of_a_loop(spark, balls, rate):
    got = _ordered(decay.decayed_histories(evidence.labelled(balls), rate, "batter"), "batter", *COUNTS, *(f"batter_{c}" for c in COUNTS))
    seen, last = defaultdict(lambda: [0.0] * 7), {}
    for step, r in enumerate(got):
        if r.batter is not None:
            aged = [x * rate ** (step - last.get(r.batter, 0)) for x in seen[r.batter]]
            want = [x / rate for x in aged]
            assert all(abs(r[f"batter_{c}"] - w) < 1e-6 for c, w in zip(COUNTS, want, strict=True))
            seen[r.batter], last[r.batter] = [x + r[c] for x, c in zip(aged, COUNTS, strict=True)], step
    assert evaluate.decayed_counts(balls, rate).count() == len(got)
