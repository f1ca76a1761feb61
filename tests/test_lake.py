"""Loads into versioned tables: skip, switch, failure, rejects; upserts and nested records."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_ingest import BALL

from pitchframe.functions.expr import overs_notation, timeline_key
from pitchframe.operators import evaluate, trust
from pitchframe.sources import ingest, lake


def _file(path, *changes, columns=ingest.COLUMNS):
    path.write_text("\n".join([",".join(columns), *(",".join((BALL | c).get(k, "z") for k in columns) for c in changes)]) + "\n", encoding="utf-8")
    return str(path)


def test_loads_skips_switches_and_keeps_the_last_good_version(spark, tmp_path):
    base, path = str(tmp_path / "lake"), tmp_path / "balls.csv"
    _file(path, {"ball_number": "0"}, {"ball_number": "1"}, {"ball_number": "1"})
    first = lake.load(spark, str(path), base)
    assert (first.skipped, first.n_raw, first.n_rejected, first.n_accepted) == (False, 3, 1, 2)
    again = lake.load(spark, str(path), base)
    assert again.skipped and again.version == first.version
    forced = lake.load(spark, str(path), base, force=True)
    assert not forced.skipped and forced.version != first.version
    _file(path, *({"ball_number": str(i)} for i in range(5)))
    os.utime(path, (2_000_000_000, 2_000_000_000))
    second = lake.load(spark, str(path), base)
    assert (second.skipped, second.n_accepted) == (False, 5)
    assert sorted(r.source_row_number for r in lake.table(spark, base, "deliveries").collect()) == [2, 3, 4, 5, 6]
    assert lake.table(spark, base, "deliveries").orderBy("ball_number").first()["timeline_key"] == "2020-00000001-01-00-00"
    # A header without a column of the contract: the load fails, its row says so, readers see the tables as before.
    _file(path, {}, columns=[c for c in ingest.COLUMNS if c != "bowler"])
    os.utime(path, (2_000_000_100, 2_000_000_100))
    with pytest.raises(ValueError, match="bowler"):
        lake.load(spark, str(path), base)
    assert lake.table(spark, base, "raw").count() == 5 and lake.table(spark, base, "rejects").count() == 0
    (state,) = lake.status(spark, base).collect()
    assert state.last_status == "failed" and "bowler" in state.message and state.version == second.version
    with pytest.raises(ValueError):
        lake.table(spark, str(tmp_path / "none"), "raw")


def test_columns_beyond_the_contract_are_left_out(spark, tmp_path):
    assert ingest.header_problems([*ingest.COLUMNS, "weather"]) == ([], ["weather"])
    path = _file(tmp_path / "more.csv", {"ball_number": "0"}, columns=(*ingest.COLUMNS, "weather"))
    assert "weather" not in ingest.read_csv(spark, path).columns


def test_rows_are_numbered_across_splits(spark, tmp_path):
    path = _file(tmp_path / "long.csv", *({"match_id": str(i)} for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ingest.read_csv(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        assert {(r.match_id, r.source_row_number) for r in rows.collect()} == {(str(i), i + 2) for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hashes(spark, tmp_path):
    a, b = _file(tmp_path / "a.csv", {}), _file(tmp_path / "b.csv", {"batter": "Other"})
    assert lake.content_hash(spark, a) == lake.content_hash(spark, a) != lake.content_hash(spark, b)
    assert lake.schema_hash(spark, ["a", "b"]) != lake.schema_hash(spark, ["b", "a"])


def test_profile(spark, tmp_path):
    path = _file(tmp_path / "p.csv", {}, {}, {"ball_number": "x"}, {"is_wicket": "?", "ball_number": "7", "batter": ""}, {"match_id": "2", "is_super_over": "1"})
    (r,) = ingest.profile(ingest.read_csv(spark, path)).collect()
    assert (r.rows, r.exact_repeats, r.duplicate_delivery_identity, r.bad_ball_number, r.bad_is_wicket, r.blank_batter) == (5, 1, 1, 1, 1, 1)
    assert (r.least_balls, r.most_balls, r.mean_balls, r.super_over_rows) == (1, 4, 2.5, 1)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "Ann", None, 1), ("b", "Bob", "x", 1)], "key string, full_name string, team string, batch int")
    new = spark.createDataFrame([("a", None, "t", 2), ("c", "Cy", None, 2)], "key string, full_name string, team string, batch int")
    both = ingest.latest(old.unionByName(new), ["key"], "batch").collect()
    assert {r.key: r.full_name for r in both} == {"a": None, "b": "Bob", "c": "Cy"}
    assert {r.key: (r.full_name, r.team) for r in ingest.filled(old, new, ["key"]).collect()} == {"a": ("Ann", "t"), "b": ("Bob", "x"), "c": ("Cy", None)}
    x = spark.createDataFrame([("a", "Ann", 0.4), ("b", None, 0.9)], "key string, full_name string, confidence double")
    y = spark.createDataFrame([("a", "Anna", 0.7), ("b", "Bo", 0.1)], "key string, full_name string, confidence double")
    assert {tuple(r) for r in ingest.better_known(x, y, "key").collect()} == {("a", "Ann", 0.7), ("b", "Bo", 0.9)}


def test_nested_records_backfill_and_names(spark):
    ball = {"batter": "A", "bowler": "B", "non_striker": "C", "runs": {"batter": 1, "extras": 0, "total": 1}}

    def record(season, teams, outcome):
        info = {"season": season, "dates": ["2020-09-19"], "teams": teams, "venue": "V", "toss": {"winner": teams[0], "decision": "bat"}, "outcome": outcome}
        return json.dumps({"info": info, "innings": [{"team": t, "overs": [{"over": 0, "deliveries": [ball]}]} for t in teams]})

    rows = [(1, record("2019", ["Reds", "Blues"], {"winner": "Reds", "by": {"runs": 3}})), (2, record("2020/21", ["Blues", "Greens"], {"winner": "Greens", "by": {"wickets": 5}})),
            (3, record("2020/21", ["Reds", "Greens"], {"result": "tie"}))]
    df = spark.createDataFrame(rows, "match_id int, j string").selectExpr("match_id", f"from_json(j, '{ingest.MATCH_JSON}') AS m").select("match_id", "m.*")
    got = {r.match_id: (r.season_id, r.winner, r.result_type, r.margin, r.toss_decision) for r in ingest.match_records(df).collect()}
    assert got == {1: (2019, "Reds", "runs", 3, "bat"), 2: (2020, "Greens", "wickets", 5, "bat"), 3: (2020, None, None, None, "bat")}
    ours = spark.createDataFrame([(2, 1, "BLU"), (2, 2, "GRE"), (9, 1, "ZZZ")], "match_id int, innings int, team_batting string")
    assert {r.match_id for r in ingest.backfill(df, ours).collect()} == {3}
    codes = ingest.team_codes(df, ours)
    assert {tuple(r) for r in codes.collect()} == {(2, "BLU", "Blues"), (2, "GRE", "Greens")}
    assert {r.batting_name for r in ingest.named_teams(ours, codes).collect()} == {"Blues", "Greens", "ZZZ"}


def test_small_columns_and_guards(spark):
    row = spark.createDataFrame([(2020, 7, 1, 3, 4, 20)], "season_id int, match_id int, innings int, over_number int, ball_number int, legal int")
    assert row.select(overs_notation("legal").alias("o"), timeline_key().alias("t")).first() == ("3.2", "2020-00000007-01-03-04")
    gates = spark.createDataFrame([(2019, "PASS"), (2020, "BLOCKED_COVERAGE")], "season_id int, gate string")
    assert [trust.allowed(gates, s) for s in (2018, 2019, 2020)] == [True, True, False]
    assert evaluate.nested_split(2019, 2020) == (2018, 2019)
    with pytest.raises(ValueError):
        evaluate.nested_split(2020, 2020)


def test_the_content_hash_knows_the_order_and_not_the_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    whole = lake.content_hash(spark, str(tmp_path / "a.csv"))
    found = set()
    for cut in ("3000", "777", "50000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found.add(lake.content_hash(spark, str(tmp_path / "a.csv")))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {whole}
    others = {whole}
    for k, other in enumerate(([*lines[1:], lines[0]], [lines[1], lines[0], *lines[2:]], lines[:-1], [*lines, ""], [*lines[:9], "", *lines[9:]])):
        (tmp_path / f"b{k}.csv").write_text("\n".join(other) + "\n")
        others.add(lake.content_hash(spark, str(tmp_path / f"b{k}.csv")))
    assert len(others) == 6
    (tmp_path / "none.csv").write_text("")
    assert lake.content_hash(spark, str(tmp_path / "none.csv")) == "0" * 16


def test_equal_contents_with_a_new_time_stamp_are_not_loaded_again(spark, tmp_path):
    base, path = str(tmp_path / "lake"), tmp_path / "balls.csv"
    _file(path, {"ball_number": "0"}, {"ball_number": "1"})
    first = lake.load(spark, str(path), base)
    os.utime(path, (2_000_000_000, 2_000_000_000))
    again = lake.load(spark, str(path), base)
    assert again.skipped and again.version == first.version and lake.table(spark, base, "raw").count() == 2
    _file(path, {"ball_number": "1"}, {"ball_number": "0"})
    os.utime(path, (2_000_000_001, 2_000_000_001))
    assert not lake.load(spark, str(path), base).skipped


def _seasons_held(spark, base):
    return lake.latest_loads(spark, base).first()["seasons"]


def test_merges_write_the_seasons_they_touch_and_switch_by_the_manifest(spark, tmp_path):
    base, path = str(tmp_path / "lake"), tmp_path / "balls.csv"
    _file(path, *({"season_id": s, "match_id": s, "ball_number": str(i)} for s in ("2019", "2020", "2021") for i in range(3)))
    first = lake.load(spark, str(path), base)
    whole = lambda: sorted(tuple(r) for r in lake.table(spark, base, "deliveries").select(*ingest.IDENTITY, "batter", "total_runs").collect())
    before = whole()
    # Backfill: new balls of a match, one of them twice, one that is there already, one without a match.
    new = [(2020, 2020, 1, 0, 2, "Other", 4), (2020, 77, 1, 0, 1, "New", 1), (2020, 77, 1, 0, 1, "Later", 2), (2022, 5, 1, 0, 0, "Next", 0), (2020, None, 1, 0, 0, "Lost", 0)]
    kinds = "season_id int, match_id long, innings int, over_number int, ball_number int, batter string, total_runs int, weather string, source_row_number long"
    rows = spark.createDataFrame([(*r, "sun", k) for k, r in enumerate(new)], kinds)
    got = lake.merge(spark, base, "balls.csv", rows)
    want = sorted([*before, (2020, 77, 1, 0, 1, "New", 1), (2022, 5, 1, 0, 0, "Next", 0)])
    assert whole() == want and got.n_accepted == 11 and lake.table(spark, base, "raw").count() == 9
    held = _seasons_held(spark, base)
    assert held == {2019: first.version, 2021: first.version, 2020: got.version, 2022: got.version}
    assert sorted(p for p in os.listdir(f"{base}/versions/{got.version}/deliveries") if p.startswith("season")) == ["season_id=2020", "season_id=2022"]
    # Done again, the table is the same and no season is written.
    again = lake.merge(spark, base, "balls.csv", rows)
    assert whole() == want and again.n_accepted == 11 and _seasons_held(spark, base) == held
    # Replace: the rows that are there give way, of equal ones the last counts.
    lake.merge(spark, base, "balls.csv", rows, replace=True)
    want = sorted([r for r in want if r[:5] not in {n[:5] for n in new}] + [new[0], new[2], new[3]])
    assert whole() == want and _seasons_held(spark, base)[2019] == first.version
    # A merge that fails leaves the last version.
    with pytest.raises(Exception, match="[Dd]ivi"):
        lake.merge(spark, base, "balls.csv", rows.withColumn("total_runs", F.expr("1 div (ball_number - ball_number)")))
    assert whole() == want and lake.status(spark, base).first().last_status == "failed"
    assert lake.load(spark, str(path), base).skipped  # the file itself has not changed
    with pytest.raises(ValueError, match="0 sources"):
        lake.merge(spark, base, "none.csv", rows)
