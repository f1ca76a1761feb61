"""Ingestion of small files, and streams against static tables."""

import json

import pytest

from pitchframe.functions.expr import COUNTS
from pitchframe.operators import aggregates, evidence
from pitchframe.sources import ingest
from pitchframe.sources.adapter import deliveries
from pitchframe.streaming import events

BALL = dict.fromkeys(ingest.INTEGERS, "0") | dict.fromkeys(ingest.BOOLEANS, "FALSE") | dict.fromkeys(ingest.TEXTS, "")
BALL |= {"season_id": "2020", "match_id": "1", "innings": "1", "batter": "PlayerA", "bowler": "BowlerX", "team_batting": "Team1", "team_bowling": "Team2"}


def _rows(spark, tmp_path, *changes, columns=ingest.COLUMNS):
    path = tmp_path / "balls.csv"
    path.write_text("﻿" + "\n".join([",".join(columns), *(",".join((BALL | c)[k] for k in columns) for c in changes)]) + "\n", encoding="utf-8")
    return ingest.validated(ingest.read_csv(spark, str(path)))


def test_accepts_and_rejects_with_all_errors(spark, tmp_path):
    rows = _rows(
        spark, tmp_path, {"ball_number": "0"}, {"ball_number": "1", "batter_runs": "4.0", "total_runs": "4"},
        {"ball_number": "2", "is_wide_ball": "t", "extras": "1", "wide_ball_runs": "1", "total_runs": "1"},
        {"ball_number": "3", "total_runs": "7", "batter": " "}, {"ball_number": "3"}, {"ball_number": "x", "is_wicket": "maybe"},
        {"ball_number": "5", "is_wicket": "1"},
    )
    good = {r.source_row_number: r for r in ingest.accepted(rows).collect()}
    assert sorted(good) == [2, 3, 4]
    assert good[3].batter_runs == 4 and good[4].legal_ball == 0 and good[2].non_striker is None
    bad = {r.source_row_number: r.errors for r in ingest.rejected(rows).collect()}
    assert bad == {
        5: "missing:batter|run_total_mismatch", 6: "duplicate_delivery_identity", 7: "not_integer:ball_number=x|invalid_boolean:is_wicket=maybe",
        8: "wicket_flag_without_detail",
    }


def test_missing_column_is_fatal(spark, tmp_path):
    with pytest.raises(ValueError, match="bowler"):
        _rows(spark, tmp_path, {}, columns=[c for c in ingest.COLUMNS if c != "bowler"])


def test_nested_matches(spark):
    balls = [{"batter": "A", "bowler": "B", "runs": {"batter": 0, "extras": 1, "total": 1}, "extras": {"wides": 1}},
             {"batter": "A", "bowler": "B", "runs": {"batter": 0, "extras": 0, "total": 0},
              "wickets": [{"player_out": "A", "kind": "caught", "fielders": [{"name": "C"}, {"name": "D"}]}]}]
    match = {"info": {"season": "2007/08"}, "innings": [{"team": "T", "overs": [{"over": 0, "deliveries": balls}]}]}
    df = spark.createDataFrame([(1, json.dumps(match))], "match_id int, j string")
    parsed = df.selectExpr("match_id", f"from_json(j, '{ingest.MATCH_JSON}') AS m").select("match_id", "m.*")
    got = ingest.flattened(parsed).orderBy("ball_number").collect()
    assert [(r.season_id, r.ball_number, r.wide_ball_runs, r.is_wicket) for r in got] == [(2008, 1, 1, 0), (2008, 2, 0, 1)]
    assert got[1].fielders_involved == "C, D" and got[0].wicket_kind is None


def test_streamed_replay_equals_history(spark, tmp_path):
    balls = deliveries(spark, "/root/testdata/sf0.001").where("season_id = 1995")
    balls.orderBy("season_id", "match_id", "innings").coalesce(1).write.parquet(str(tmp_path / "balls"))
    stream = spark.readStream.schema(balls.schema).parquet(str(tmp_path / "balls"))
    query = events.replay(stream, "batter", "bowler").writeStream.format("memory").queryName("replayed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = list(evidence.CHRONOLOGY)
    want = {tuple(r) for r in evidence.asof(balls, "batter_bowler").select(*keys, *COUNTS).collect()}
    assert {tuple(r) for r in spark.table("replayed").select(*keys, *COUNTS).collect()} == want


def test_streamed_windows_equal_static(spark, tmp_path):
    static = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    static.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "events"))
    query = events.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").count() == events.hourly(static).count()


def test_nested_records_give_the_deliveries_again_and_their_counts(spark):
    balls = deliveries(spark, "/root/testdata/sf0.001").where("season_id < 1998")
    matches = ingest.nested(balls)
    same = ["season_id", "match_id", "team_batting", "over_number", "batter", "bowler", "batter_runs", "extras", "total_runs", "wide_ball_runs", "player_out", "wicket_kind", "is_wicket"]
    a, b = ingest.flattened(matches).select(*same), balls.select(*same)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < b.count()
    a, b = ingest.nested_quality(matches), aggregates.season_quality(balls)
    assert {tuple(r) for r in a.select(*b.columns).collect()} == {tuple(r) for r in b.collect()}
    odd = [(1, '{"info": {"season": "2020/21"}}'), (2, '{"info": {"season": "2020"}, "innings": [{"overs": null}, null, {"overs": [{"deliveries": [{}, {"runs": {"batter": 4}, "extras": {"wides": 1}, "wickets": []}]}]}]}'), (3, '{"innings": []}')]
    rows = spark.createDataFrame(odd, "match_id long, j string").selectExpr("match_id", f"from_json(j, '{ingest.MATCH_JSON}') AS m").select("match_id", "m.*")
    assert [tuple(r) for r in ingest.nested_quality(rows).collect()] == [(2020, 2, 2, 1, 0, 0, 1, 1)]
