"""Match records read from archives without unpacking, in ranges, with broken members as rejects."""

import json
import zipfile

import pytest

from pitchframe.sources import archive, ingest


def _record(season, n, teams=("Reds", "Blues")):
    balls = [{"batter": f"A{k}", "bowler": "B", "non_striker": "C", "runs": {"batter": k % 4, "extras": 0, "total": k % 4}, "unknown": [1, {"x": 2}]} for k in range(n)]
    info = {"season": season, "dates": ["2020-09-19"], "teams": list(teams), "venue": "V", "toss": {"winner": teams[0], "decision": "bat"}, "outcome": {"winner": teams[0], "by": {"runs": 3}}}
    return {"info": info, "meta": {"v": 1}, "innings": [{"team": t, "overs": [{"over": 0, "deliveries": balls}]} for t in teams]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(archive.MatchArchive)
    at = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(at / "one.zip", "w", zipfile.ZIP_DEFLATED) as file:
        for i in range(60):
            file.writestr(f"{i}.json", json.dumps(_record(2019 if i % 2 else "2020/21", 3 + i % 4)))
        file.writestr("README.txt", "no record")
        file.writestr("notes/7.json", "{}")
        file.writestr("x9.json", "{}")
        file.writestr("900.json", '{"info": {')
        file.writestr("901.json", "[1, 2]")
        file.writestr("902.json", json.dumps({"info": {"season": "2019", "teams": "not a list"}}))
        file.writestr("903.json", "{}")
    whole = (at / "one.zip").read_bytes()
    with zipfile.ZipFile(at / "two.zip", "w", zipfile.ZIP_STORED) as file:
        file.writestr("1000.json", json.dumps(_record("2021", 2)))
        file.writestr("1001.json", json.dumps(_record("2021", 2)))
    stored = bytearray((at / "two.zip").read_bytes())
    stored[stored.index(b"1001.json") + 40] ^= 1  # a bit of the member's data: its checksum fails
    (at / "two.zip").write_bytes(stored)
    (at / "other.bin").write_bytes(whole[:50])
    return at


def test_records_are_those_of_the_unpacked_files(spark, folder):
    rows = spark.read.format("match_archive").option("rangeBytes", 500).load(str(folder))
    assert rows.rdd.getNumPartitions() > 5
    good = archive.readable(rows)
    plain = [(i, json.dumps(_record(2019 if i % 2 else "2020/21", 3 + i % 4))) for i in range(60)] + [(903, "{}"), (1000, json.dumps(_record("2021", 2)))]
    want = spark.createDataFrame(plain, "match_id long, j string").selectExpr("match_id", f"from_json(j, '{ingest.MATCH_JSON}') AS m").select("match_id", "m.*")
    for f in (ingest.flattened, ingest.match_records):
        a, b = f(good), f(want)
        assert a.columns == b.columns and a.count() == b.count() > 50
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_broken_members_are_rejects(spark, folder):
    rows = spark.read.format("match_archive").load(f"file://{folder}")
    assert {r.member: r.problem.split(":")[0] for r in archive.rejects(rows).collect()}.keys() == {"900.json", "901.json", "902.json", "1001.json"}
    assert {r.match_id for r in archive.rejects(rows).collect()} == {900, 901, 902, 1001}
    with pytest.raises(Exception, match="zip"):
        spark.read.format("match_archive").load(str(folder / "other.bin")).count()


def test_a_schema_prunes_columns_and_nested_fields(spark, folder):
    rows = spark.read.format("match_archive").schema("match_id long, info struct<season:string>, problem string").load(str(folder / "one.zip"))
    assert rows.count() == 64 and {r.info.season for r in rows.where("match_id < 60").collect()} == {"2019", "2020/21"}
    only = spark.read.format("match_archive").schema("match_id long").load(f"{folder}/one.zip, {folder}/two.zip")
    assert only.count() == 66  # nothing is unpacked, so nothing is broken
    (folder / "none").mkdir(exist_ok=True)
    assert spark.read.format("match_archive").load(str(folder / "none")).count() == 0
