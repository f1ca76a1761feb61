"""The frame of features: balls go through one exchange by innings, which carries a number for their columns, and similar balls by sums of innings."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchframe import all_queries
from pitchframe.functions.expr import COUNTS
from pitchframe.operators import evidence, models
from pitchframe.sources import adapter

SF = "/root/testdata/sf0.001"


def _dealt(spark, sf_dir):
    plain, sides = adapter.deliveries(spark, sf_dir), adapter.sides(spark, sf_dir)
    return adapter.Dealt(evidence.with_venue(adapter.deliveries(spark, sf_dir, cut=True), adapter.match_meta(sides)), plain, sides, adapter.ball_tasks(spark, sf_dir))


def test_dealt_balls_of_odd_lines_are_the_same(spark, monkeypatch, tmp_path):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    n = F.col("l_orderkey") % 7
    odd = {
        "l_suppkey": F.when(n == 0, None).when(n == 1, -F.col("l_suppkey") - 45).otherwise(F.col("l_suppkey")), "l_partkey": F.when(n == 2, None).when(n == 1, -F.col("l_partkey")).otherwise(F.col("l_partkey")),
        "l_linenumber": F.when(n == 3, 9).when(n == 4, None).otherwise(F.col("l_linenumber")), "l_quantity": F.when(n == 5, None).otherwise(F.col("l_quantity")),
    }
    lines.withColumns(odd).union(lines.withColumn("l_extendedprice", F.col("l_extendedprice") + 1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate"))).write.parquet(f"{tmp_path}/orders.parquet")
    few = adapter.deliveries(spark, str(tmp_path))
    monkeypatch.setattr(adapter, "LINES", 100)
    assert sorted(map(str, adapter.match_meta(adapter.sides(spark, str(tmp_path))).collect())) == sorted(map(str, adapter.match_meta(few).collect()))
    for cut in (False, True):
        many = adapter.deliveries(spark, str(tmp_path), cut=cut)
        assert many.schema.simpleString() == few.schema.simpleString()
        assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_the_exchange_by_innings_carries_one_number_for_a_balls_columns(spark, monkeypatch):
    monkeypatch.setattr(adapter, "LINES", 100)
    frame, seen = type(spark.range(1)), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (seen.append((a[1:], self.columns)), real(self, *a))[1])
    adapter.deliveries(spark, SF, cut=True)
    assert [c for by, c in seen if by == adapter.INNINGS] == [[*adapter.INNINGS, "d", "l_orderkey", "line", "packed"]]


@pytest.mark.parametrize("season", [None, 1996])
def test_dealt_balls_stay_where_they_are_for_the_pass(spark, monkeypatch, season):
    monkeypatch.setattr(adapter, "LINES", 100)
    monkeypatch.setattr(adapter, "BALLS", 500)
    dealt = _dealt(spark, SF)
    rows = models.feature_frame(dealt, season)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Balls before anything is made of them, in three branches of totals and in the pass, and the totals that meet them there.
    by_innings = re.findall(r"Exchange hashpartitioning\(season_id#\d+L?, match_id#\d+L?, innings#\d+, (\d+)\), (\w+)", plan)
    assert by_innings == [("12", "REPARTITION_BY_NUM")] * 5
    whole = models.feature_frame(dealt.balls, season)
    assert sorted(rows.columns) == sorted(whole.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, whole.select(*rows.columns).collect()))


@pytest.mark.parametrize("enough", [(2, 4), (1, 3)])
def test_similar_situations_by_sums_of_innings_are_those_of_a_loop(spark, monkeypatch, enough):
    levels = tuple((k, n) for (k, _), n in zip(evidence.SIMILAR, (*enough, 1), strict=True))
    monkeypatch.setattr(evidence, "SIMILAR", levels)
    n = F.col("source_row_number")
    balls = adapter.deliveries(spark, SF).where("season_id < 1997")
    # Sides with two names and with none in one innings, and few types, so that all levels are reached.
    team = F.when(n % 17 == 0, None).when(n % 5 == 0, "A").otherwise("B")
    balls = balls.withColumns({"team_batting": team, "team_bowling": F.lit("C"), "batsman_type": F.lit("left-hand"), "bowler_type": F.when(n % 19 == 0, None).otherwise(F.lit("pace"))})
    rows = evidence.labelled(balls).cache()
    got = {tuple(r)[:6]: r for r in evidence.similar_situations(rows).collect()}
    seen, reached = defaultdict(Counter), Counter()
    for r in sorted(evidence.windowed(rows).collect(), key=lambda r: tuple(r[c] for c in evidence.CHRONOLOGY)):
        found = []
        for name, (_, asked) in evidence.SIMILAR_KEYS.items():
            key = (name, *(r[k] for k in asked))
            found.append(seen[key] if None not in key else Counter())
        level = next(i for i in range(3) if i == 2 or sum(found[i].values()) >= levels[i][1])
        mine = got[tuple(r[c] for c in evidence.CHRONOLOGY)]
        assert [mine.similar_level, *(mine[f"similar_{c}"] for c in COUNTS)] == [level, *(found[level][c] for c in COUNTS)]
        reached[level] += 1
        for name, (counted, _) in evidence.SIMILAR_KEYS.items():
            key = (name, *(r[k] for k in counted))
            if None not in key:
                seen[key].update({c: r[c] for c in COUNTS})
    assert len(got) == sum(reached.values()) > 1500 and len(reached) == 3


def test_totals_that_no_ball_looks_at_are_left_out(spark, monkeypatch):
    rows = evidence.windowed(evidence.labelled(adapter.deliveries(spark, SF).where("season_id < 1996"))).cache()
    found = []
    for enough in ((1, 1), (10**6, 1), (10**6, 10**6)):
        monkeypatch.setattr(evidence, "SIMILAR", tuple((k, n) for (k, _), n in zip(evidence.SIMILAR, (*enough, 1), strict=True)))
        found.append({r.context for r in evidence.over_totals(rows).select("context").distinct().collect()})
    assert found == [{"s0", "s1"}, {"s1"}, set()]


@pytest.mark.parametrize("name", ["q_family_source", "q_family_adjust", "q_candidate_blends", "q_feature_ledger", "q_blend_contributions"])
def test_what_is_spread_over_rows_is_compiled_and_computed_once(spark, name):
    plan = all_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    generators = re.findall(r"Generate explode\((\w+)", plan)
    # Keys of histories and overs are few and narrow; what is spread is a column of the projection in front, which no inferred condition repeats.
    assert sum(g in ("f", "r", "e", "c") for g in generators) == 1
    assert "size(array(" not in plan
