"""CSV records over splits against a standard CSV reader, and the odd ones."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchframe.sources import ingest, records


@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _read(spark, path, names=("a", "b", "c")):
    rows = records.parsed(records.records(records.lines(spark, str(path))), list(names), tuple(names))
    return [(r.row, r.problem, *(r[c] for c in names)) for r in rows.orderBy("row").collect()]


def _standard(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from('a",'), max_size=12))
def test_lines_end_inside_quotes_where_a_standard_reader_says_so(line):
    """A reader that is inside quotes reads on into the next line."""
    for inside in (False, True):
        got = next(csv.reader(io.StringIO(('"' if inside else "") + line + "\nEND", newline=""))) or [""]
        assert records.ends_inside(line, inside) == got[-1].endswith("\nEND")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_of_a_standard_reader_over_many_splits(spark, tmp_path, small_splits, end):
    draw = random.Random(4)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", "b", "c"])
    kinds = ["x", "", '["A \'B\' C", "D"]', 'say "hi"', "two\nlines", "cr\r\nlf", '"', '""\n"', ",", "é中", " lead", "one\n\n\nfour"]
    n = 100_000 if end == "\n" else 3000
    for i in range(n):
        writer.writerow([i, draw.choice(kinds), draw.choice(kinds)])
    out.write(f'plain,with "quotes" inside,5" pipe{end}{end}"closed"tail,"a""b"x"y,z{end}')
    path = tmp_path / "all.csv"
    path.write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    small_splits(50_000 if end == "\n" else 700)
    assert records.lines(spark, str(path)).select("start").distinct().count() > 30
    want = [(k + 2, None, *r) for k, r in enumerate(_standard(out.getvalue())[1:])]
    assert _read(spark, path) == want and len(want) == n + 2


def test_records_of_few_and_many_fields_and_quotes_left_open(spark, tmp_path, small_splits):
    path = tmp_path / "odd.csv"
    path.write_text('a,b,c\n1,2\n1,2,3,4\n"a\nb",2,3\n\n  \n' + "5,6,7\n" * 3 + '8,"never closed,9\n' + "10,11,12\n" * 40)
    small_splits(64)
    got = _read(spark, path)
    assert got[:3] == [(2, "too_few_fields:2", "1", "2", None), (3, "too_many_fields:4", "1", "2", "3"), (4, None, "a\nb", "2", "3")]
    assert got[3] == (5, "too_few_fields:1", "  ", None, None) and got[4:7] == [(k, None, "5", "6", "7") for k in (6, 7, 8)]
    assert got[7:] == [(9, "unclosed_quote", None, None, None)]


def test_a_long_record_over_several_lines(spark, tmp_path, small_splits):
    path = tmp_path / "long.csv"
    path.write_text("a,b,c\n1,\"" + "line\n" * 2000 + "\",3\n4,5,6\n")
    small_splits(512)
    found = records.records(records.lines(spark, str(path)), longest=9000)
    assert [(r.row, r.problem) for r in found.orderBy("row").collect()] == [(1, None), (2, "unclosed_quote"), (3, None)]
    assert _read(spark, path) == [(2, None, "1", "line\n" * 2000, "3"), (3, None, "4", "5", "6")]


def test_several_files_have_one_header_and_one_count(spark, tmp_path):
    for k, rows in enumerate(["a,b,c\n1,2,3\n", "a,b,c\n", '"a",b,c\n"4\n",5,6\n7,8,9']):
        (tmp_path / f"{k}.csv").write_text(rows)
    assert [(r[0], r[2]) for r in _read(spark, tmp_path)] == [(2, "1"), (3, "4\n"), (4, "7")]
    with pytest.raises(ValueError, match="different headers"):
        records.header(spark, str(tmp_path))
    empty = tmp_path / "none.csv"
    empty.write_text("")
    assert _read(spark, empty) == [] and records.header(spark, str(empty)) == []


def test_rows_of_other_lengths_are_rejected_with_their_numbers(spark, tmp_path):
    ball = dict.fromkeys(ingest.INTEGERS, "0") | dict.fromkeys(ingest.BOOLEANS, "0") | dict.fromkeys(ingest.TEXTS, "")
    ball |= {"season_id": "2020", "match_id": "1", "innings": "1", "batter": "A", "bowler": "B", "team_batting": "T", "team_bowling": "U"}
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(ingest.COLUMNS)
    names = ['["A \'B\' C", "D"]', 'say "hi"', "two\nlines", "plain"]
    for k, name in enumerate(names):
        writer.writerow((ball | {"ball_number": str(k), "fielders_involved": name})[c] for c in ingest.COLUMNS)
    writer.writerow([2020, 1])
    writer.writerow([*((ball | {"ball_number": "9"})[c] for c in ingest.COLUMNS), "more"])
    path = tmp_path / "balls.csv"
    path.write_bytes(out.getvalue().encode())
    rows = ingest.validated(ingest.read_csv(spark, str(path)))
    assert {r.source_row_number: r.fielders_involved for r in ingest.accepted(rows).collect()} == dict(zip(range(2, 6), names, strict=True))
    bad = {r.source_row_number: r.reason for r in ingest.rejected(rows).collect()}
    assert bad == {6: "too_few_fields:2", 7: f"too_many_fields:{len(ingest.COLUMNS) + 1}"}
