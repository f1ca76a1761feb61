"""Counts in one pass over innings, however the batches and codes are cut, against a loop over all balls; no window holds a block of matches."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchframe.functions.expr import COUNTS
from pitchframe.operators import counting, evidence, models, state
from pitchframe.sources.adapter import deliveries


@pytest.fixture(scope="module")
def rows(spark):
    balls = deliveries(spark, "/root/testdata/sf0.001").where("season_id < 1996")
    n = F.col("source_row_number")
    balls = balls.withColumns({"batter": F.when(n % 13 == 0, None).otherwise(F.col("batter")), "team_batting": F.when(n % 17 == 0, None).otherwise(F.col("team_batting"))})
    return evidence.windowed(evidence.labelled(balls)).cache()


def _ordered(rows):
    return sorted(rows.collect(), key=lambda r: tuple(r[c] for c in evidence.CHRONOLOGY))


@pytest.mark.parametrize(("batch", "forget"), [(10000, None), (7, 5)])
def test_counts_do_not_depend_on_batches(spark, rows, monkeypatch, batch, forget):
    if forget:
        real = counting.counted
        monkeypatch.setattr(evidence, "_counted", lambda *a: (lambda run: lambda batches: (setattr(__import__("pitchframe.operators.counting", fromlist=["x"]), "FORGET", forget), (yield from run(batches)))[1])(real(*a)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = _ordered(evidence.histories(rows, "batter", "global", *evidence.SIMILAR_KEYS))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == rows.count() > 500
    kinds = {"batter": (("batter",),) * 2, "global": ((), ()), **evidence.SIMILAR_KEYS}
    seen = defaultdict(Counter)
    for r in got:
        for name, (counted, asked) in kinds.items():
            key = (name, *(r[k] for k in asked))
            assert [r[f"{name}_{c}"] for c in COUNTS] == ([seen[key][c] for c in COUNTS] if None not in key else [0] * 7)
        for name, (counted, _) in kinds.items():
            key = (name, *(r[k] for k in counted))
            if None not in key:
                seen[key].update({c: r[c] for c in COUNTS})


def test_no_window_holds_a_block_of_matches(rows):
    plan = evidence.histories(rows, "global", "batter", "phase")._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.splitlines() if "Window [" in line and "_block" in line]
    assert not held
    assert evidence.histories(rows, "batter", season=1995).count() == rows.where("season_id = 1995").count()


def test_an_empty_table_has_no_histories(rows):
    assert evidence.histories(rows.limit(0), "batter", "s0").count() == 0


def test_sums_of_an_innings_in_the_pass_are_those_of_a_loop(spark, rows):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = _ordered(evidence.histories(state.with_played(rows), "batter", inside=state.with_recent, sums=state.PLAY))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(got) == rows.count() > 500
    seen, last = defaultdict(Counter), defaultdict(list)
    for r in got:
        innings = (r.season_id, r.match_id, r.innings)
        for key, of in state.PLAY.items():
            held = seen[innings, key, r[key]]
            assert [r[n] for n in of] == [held[n] for n in of]
            held.update({n: r[c] for n, c in of.items()})
        assert r.recent == " ".join(last[innings][-6:]) and r.recent_wicket == last[innings][-6:].count("wicket")
        last[innings].append(r.label)


def test_exchanges_of_the_feature_frame_carry_no_state_of_play(rows, monkeypatch):
    frame, seen = type(rows), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (seen.append(set(self.columns)), real(self, *a))[1])
    got = models.feature_frame(rows.drop("score_before", "wickets_before", "legal_before", "label", *COUNTS))
    made = {"striker_runs", "spell_balls", "partnership_runs", "recent", "recent_wicket", "window_runs", "gap"}
    assert made <= set(got.columns) and len(seen) >= 3 and not made & set().union(*seen)
