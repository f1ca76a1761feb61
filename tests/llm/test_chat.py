"""Quotation linking against its SQL, and by hand, on nested, edited, unknown and repeated quotes and long threads."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import rows_of

from pitchframe.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, thread string, depth double, passage int"  # the last three clash
MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nAnd how do I reverse it?"),
    (1, 1, "assistant", "> How do I sort a list?\n\nUse sorted().\n\n> And how do I REVERSE  it?\nUse reversed()."),
    (1, 2, "user", "On Monday X wrote:\n> > How do I sort a list?\n> Use sorted().\n\n\n\nThanks, that works."),
    (1, 3, "assistant", ">> Use sorted().\n> Thanks, that works.\n> a line that nobody wrote\nYou are welcome."),
    (1, 4, "user", "> nobody said this\n>\n> nor this\nA reply to nothing."),
    (1, 5, "user", ">Use reversed().\n>  \n>   Use sorted().\nBoth are clear."),
    (1, 6, "assistant", "> You are welcome.\n"),
    (2, 0, None, None), (2, 2, "user", ""), (2, 3, "user", "   "), (2, 3, "user", "> "), (2, 5, "user", "a > b\n >c"),
    (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 2, "user", "> same\nother"), (3, 2, "user", "> same\nother"), (3, 3, "user", "> other\n> same"),
    (None, 1, "user", "lost"), (4, None, "user", "lost"),
    (5, 1, "user", "Am Montag schrieb Y:\nDas ist kein Zitat."), (5, 2, "user", "Am Montag schrieb Y:\n> Das ist kein Zitat.\nDoch."),
    (6, 0, "user", "x y z " * 20_000), (6, 1, "user", "> " + "x y z " * 20_000 + "\nyes"),
    *((7, t, "user", f"> step {t - 1}\nstep {t}" if t else "step 0") for t in range(60)),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(*m, "x", 0.5, 1) for m in MESSAGES], SCHEMA)
    return chat.conversations(frame)


def test_same_rows_as_sql(found):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", MESSAGES)
    result = con.execute(chat.CHAT_SQL)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, result.fetchall())


def test_links_by_hand(found):
    got = {(r.conv_id, r.turn): r for r in found.collect()}
    assert [got[1, t].reply_to for t in range(7)] == [None, 0, 1, 2, 3, 1, 3]
    assert [got[1, t].thread for t in range(7)] == [0, 0, 0, 0, 4, 0, 0]
    assert [got[1, t].depth for t in range(7)] == [0, 1, 2, 3, 0, 2, 4]
    assert [got[1, t].quotes for t in range(7)] == [0, 2, 2, 2, 1, 1, 1]
    assert [got[1, t].linked for t in range(7)] == [0, 2, 2, 2, 0, 1, 1]
    assert got[1, 2].text == "Thanks, that works." and got[1, 3].text == "You are welcome." and got[1, 6].text == ""
    assert got[5, 1].text.startswith("Am Montag") and got[5, 2].text == "Doch." and got[5, 2].reply_to == 1
    assert got[6, 1].reply_to == 0 and got[6, 1].text == "yes"
    assert (got[7, 59].thread, got[7, 59].depth, got[7, 59].formatted) == (0, 59, "<|user|>\nstep 59\n")
    assert got[2, 0].text == "" and got[2, 5].linked == 0 and (None, 1) not in got and (4, None) not in got


def test_answers_stand_behind_what_they_answer(found):
    rows = [r for r in found.collect() if r.conv_id == 1]
    assert [(r.thread, r.turn) for r in rows] == sorted((r.thread, r.turn) for r in rows)


def test_empty_table(spark):
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_a_very_long_quote(spark):
    """Passages are the runs of lines of one level, blank quoted lines left out."""
    import itertools

    lines = [(i // 700 % 3, f"line {i}" if i % 11 else " ") for i in range(30_000)]
    text = "\n".join((">" * level + " " if level else "") + body for level, body in lines)
    rows = spark.createDataFrame([(1, 0, "user", "line 1"), (1, 1, "user", text), (1, 2, "user", ""), (1, 3, "user", "> \n>")], "conv_id long, turn int, role string, text string")
    got = {(r.turn, r.passage, r.level) for r in chat.passages(chat.parsed(rows)).collect()}
    kept = [x for x in lines if x[0] == 0 or x[1].strip()]
    want = {(1, k, level) for k, (level, _) in enumerate(itertools.groupby(kept, key=lambda x: x[0])) if level}
    assert got == want and len(want) > 20
