"""Facts that may be told, one named ball, and calls, on odd rows."""

import datetime

from pitchframe.operators import evaluate, facts
from pitchframe.operators.evidence import CHRONOLOGY
from pitchframe.sources.adapter import deliveries

SF = "/root/testdata/sf0.001"


def test_only_verified_facts_are_told(spark):
    rows = [("A", "verified", "India", None), ("B", " VERIFIED ", " ", "x"), ("C", "provisional", "India", "y"), ("D", None, "India", "z")]
    got = {(r.player, r.attribute): (r.value, r.told) for r in facts.player_facts(spark.createDataFrame(rows, "player string, status string, nationality string, spouse string"), "nationality", "spouse").collect()}
    assert got == {("A", "nationality"): ("India", 1), ("A", "spouse"): (None, 0), ("B", "nationality"): (None, 0), ("B", "spouse"): ("x", 1)} | {(p, a): (None, 0) for p in "CD" for a in ("nationality", "spouse")}


def test_the_latest_record_of_a_season_counts_even_if_it_may_not_be_told(spark):
    day = datetime.datetime
    rows = [("T", 2020, 1, "verified", day(2020, 1, 1), "a"), ("T", 2020, 2, "provisional", day(2020, 2, 1), "b"), ("T", 2021, 3, "verified", day(2020, 2, 1), "c"), ("T", 2021, 4, "Verified", day(2020, 2, 1), "d"),
            ("U", 2021, 5, "verified", None, "e"), ("U", 2021, 6, None, None, "f"), ("V", 2021, 7, "verified", None, None)]
    got = facts.team_season(spark.createDataFrame(rows, "team string, season_id int, id int, status string, retrieved_at timestamp, captain string"), "captain")
    assert {tuple(r) for r in got.collect()} == {("T", 2021, "d"), ("V", 2021, None)}


def test_named_balls_are_rows_of_the_trace(spark):
    balls = deliveries(spark, SF)
    trace = evaluate.trace(balls, 1997, 1998)
    first, *_, last = sorted(trace.collect(), key=lambda r: tuple(r)[: len(CHRONOLOGY)])
    for want in (first, last):
        (got,) = facts.predict_ball(balls, **{c: want[c] for c in facts.IDENTITY}).collect()
        assert got == want
    assert facts.predict_ball(balls, season_id=1998, match_id=1, innings=1, over_number=0, ball_number=0).count() == 0


def test_a_ball_without_a_call_is_missed(spark):
    balls = deliveries(spark, SF)
    trace = evaluate.trace(balls, 1997, 1998)
    none = facts.ledger_accuracy(trace, facts.same_again(balls).limit(0)).collect()
    assert all(r.called == r.user_correct == 0 and r.user_accuracy == 0 and r.revealed >= r.model_correct for r in none) and none
    report = facts.replay_report(trace).collect()
    assert all(r.predictions == r.correct + r.incorrect == r.in_powerplay + r.in_middle + r.in_death for r in report) and sum(r.predictions for r in report) == trace.count()


def test_seasons_without_a_record_are_not_told(spark):
    covered = spark.createDataFrame([(1, "complete"), (2, "incomplete"), (3, "incomplete"), (4, "complete")], "season_id int, coverage string")
    gates = spark.createDataFrame([(3, "PASS"), (4, "BLOCKED_RECONCILIATION"), (5, "UNAVAILABLE")], "season_id int, gate string")
    trust = facts.verified_coverage(covered, gates)
    assert {tuple(r) for r in trust.collect()} == {(1, 1, "ok"), (2, 0, "coverage_incomplete"), (3, 1, "ok"), (4, 0, "blocked_reconciliation"), (5, 1, "ok")}
    assert sorted(r.season_id for r in facts.told(spark.range(9).selectExpr("cast(id AS int) AS season_id"), trust).collect()) == [1, 3, 5]
