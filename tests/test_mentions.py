"""Mentions in free text: the longest non-overlapping ones, ambiguous names, initials and possessives."""

from pitchframe.operators import mentions

TEAMS = [("MI", "Mumbai Indians"), ("RCB", "Royal Challengers"), ("RR", "Rajasthan Royals"), ("KXIP", "Punjab"), ("RCX", "Royal  Challengers!")]


def _asked(spark, *questions):
    return spark.createDataFrame([(q,) for q in questions], "query string")


def test_teams_in_several_spellings_and_ambiguous_ones(spark):
    more = spark.createDataFrame([("mumbai", "MI"), ("Royals", "RR"), ("royal challengers bangalore", "RCB"), ("the kings", "KXIP"), (" ", "KXIP"), (None, "MI")], "alias string, name string")
    index = mentions.team_aliases(spark.createDataFrame(TEAMS, "team string, display string"), more)
    aliases = {(r.alias, r.name) for r in index.collect()}
    assert {("mi", "MI"), ("mumbai indians", "MI"), ("rr", "RR"), ("punjab", "KXIP")} <= aliases and ("p", "KXIP") not in aliases and ("", "KXIP") not in aliases
    asked = _asked(spark, "How did MUMBAI-Indians do?", "rcb v mi", "royal challengers!", "Royal Challengers Bangalore won", "rajasthan royals", "rr rr RR", "no team, amid x", "", None, "mumbai  the kings")
    got = {r.query: (r.team, r.candidates, r.mentions) for r in mentions.teams_named(asked, index).collect()}
    assert got["How did MUMBAI-Indians do?"] == ("MI", "MI", 1) and got["rcb v mi"] == (None, "MI|RCB", 2)
    assert got["royal challengers!"] == (None, "RCB|RCX", 1) and got["Royal Challengers Bangalore won"] == ("RCB", "RCB", 1)
    assert got["rajasthan royals"] == ("RR", "RR", 1) and got["rr rr RR"] == ("RR", "RR", 3)
    assert got["no team, amid x"] == got[""] == got[None] == (None, None, 0) and got["mumbai  the kings"] == (None, "KXIP|MI", 2)


def test_longest_matches_do_not_overlap(spark):
    index = spark.createDataFrame([("a b", "1"), ("b c d", "2"), ("d", "3"), ("a", "4"), ("c d", "5"), ("x y z x y z", "6")], "alias string, name string")
    got = {(r.query, r.i, r.form) for r in mentions.mentions(_asked(spark, "a b c d", "a b a b", "b c", "x y z x y z"), index).collect()}
    assert got == {("a b c d", 2, "b c d"), ("a b c d", 1, "a"), ("a b a b", 1, "a b"), ("a b a b", 3, "a b")}


def test_players_by_initials_and_possessives(spark):
    index = spark.createDataFrame([("sharma", "RG Sharma"), ("sharma", "I Sharma"), ("sharma", "M Sharma"), ("sharma", "Mohit Sharma"), ("kohli", "V Kohli"), ("v kohli", "V Kohli")], "alias string, player string")
    activity = spark.createDataFrame([("V Kohli", 900), ("RG Sharma", 5000), ("R Jadeja", 2400), ("M Sharma", 400), ("Z Khan", 450)], "player string, activity long")
    asked = _asked(spark, "rohit sharma or V Kohli", "sharma", "m sharma", "Kohli's runs", "Rohit's runs", "Virat's best", "Zaheer's overs", "Rov's", "none")
    got = {}
    for r in mentions.players_named(asked, index, activity).collect():
        got.setdefault(r.query, []).append((r.i, r.form, r.player))
    assert sorted(got["rohit sharma or V Kohli"]) == [(2, "sharma", "RG Sharma"), (4, "v kohli", "V Kohli")]
    assert got["sharma"] == [(1, "sharma", None)] and got["m sharma"] == [(2, "sharma", None)] and got["Kohli's runs"] == [(1, "kohli", "V Kohli")]
    assert got["Rohit's runs"] == [(0, "rohit", "RG Sharma")]
    assert not {"Virat's best", "Zaheer's overs", "Rov's", "none"} & got.keys()
