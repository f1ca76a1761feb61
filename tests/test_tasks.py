"""How much of the balls one task holds: plans that sort innings have tasks by the number of balls, and a season is read by itself."""

import re

import pytest

from pitchframe import all_queries, registry
from pitchframe.operators import evaluate, models, state
from pitchframe.sources import adapter

SF = "/root/testdata/sf0.001"
#: Queries on histories or the trace of one season.
NAMED = (
    "q_eval_by_phase", "q_calibration", "q_eval_by_evidence", "q_eval_by_outcome", "q_eval_deltas", "q_eval_metrics", "q_mixture", "q_mixture_variants",
    "q_model_selection", "q_tune_mixture", "q_replay_report", "q_sample_buckets", "q_ledger_accuracy", "q_replay_summary",
)


def test_cut_deliveries_are_the_same_in_as_many_tasks_as_their_number_needs(spark, monkeypatch):
    plain = adapter.deliveries(spark, SF)
    monkeypatch.setattr(adapter, "BALLS", 100)
    cut = adapter.deliveries(spark, SF, cut=True)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))
    sizes = state.with_state(cut).rdd.mapPartitions(lambda rows: [len({(r.season_id, r.match_id, r.innings) for r in rows})]).collect()
    assert len(sizes) == plain.count() // 100 == 60
    assert sum(sizes) == plain.select(*state.INNINGS).distinct().count()  # each in one task, for its windows too


@pytest.mark.parametrize("cut", [False, True])
def test_lines_meet_their_orders_in_as_many_tasks_as_their_number_needs(spark, monkeypatch, cut):
    few = adapter.deliveries(spark, SF, cut=cut)
    monkeypatch.setattr(adapter, "LINES", 100)
    many = adapter.deliveries(spark, SF, cut=cut)
    tasks = lambda rows: re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", rows._jdf.queryExecution().optimizedPlan().toString())
    assert tasks(few) == [] and tasks(many) == [str(few.count() // 100)] * 2 == ["60", "60"]
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_the_join_has_no_more_tasks_than_are_written_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(adapter, "LINES", 10)
    plan = adapter.deliveries(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", plan) == ["200", "200"]


@pytest.mark.parametrize("name", ["q_eval_by_outcome", "q_model_selection"])
def test_no_join_of_a_trace_goes_by_the_sessions_shuffle_partitions(spark, monkeypatch, name):
    monkeypatch.setattr(adapter, "LINES", 100)
    plan = all_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = len(re.findall(r"Join Inner, \(l_orderkey", plan))
    assert joins >= 2 and re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", plan) == ["60"] * 2 * joins


def test_a_seasons_balls_are_read_by_themselves(spark):
    rows = evaluate.trace(adapter.deliveries(spark, SF), 1996, 1997)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "row_number()" in line and "Window [" in line]
    assert windows and all(any("year(" in line and "Filter" in line for line in plan[i:]) for i in windows)
    assert all("season_id" in plan[i] for i in windows)


def test_totals_by_keys_of_the_tables_need_no_exchange_by_innings(spark):
    plain, cut = (adapter.deliveries(spark, SF, cut=c) for c in (False, True))
    exchanges = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [season_id")
    assert exchanges(models.model_hierarchical(cut, plain)) == exchanges(models.model_hierarchical(cut)) - 2
    assert exchanges(models.baseline(cut, "legal_phase", plain)) == exchanges(models.baseline(cut, "legal_phase"))  # phases are made of numbers


@pytest.mark.parametrize(("name", "cut"), [*((n, True) for n in NAMED), ("q_batter_stats", False)])
def test_queries_by_the_state_of_play_cut_their_deliveries(monkeypatch, name, cut):
    class Seen(Exception):
        pass

    def seen(spark, sf_dir, cut=False):
        raise Seen(cut)

    monkeypatch.setattr(registry, "deliveries", seen)
    with pytest.raises(Seen, match=str(cut)):  # a plan without balls' numbers needs no exchange by innings
        all_queries.QUERIES[name](None, SF)
