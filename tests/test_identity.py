"""Names with several words, list literals, ties and questions that fit nobody."""

from pyspark.sql import functions as F

from pitchframe.operators import identity

NAMES = ["V Kohli", "Virat Singh", "R Sharma", "RG Sharma", "['MS Dhoni']", "['A', 'B']", "[broken", " ", None, "O'Brien, K."]


def test_names_are_cleaned_and_have_aliases(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "player string")
    assert {r.c for r in frame.select(identity.clean(F.col("player")).alias("c")).collect()} == {"V Kohli", "Virat Singh", "R Sharma", "RG Sharma", "MS Dhoni", "O'Brien, K.", None}
    got = {}
    for r in identity.aliases(frame).collect():
        got.setdefault(r.player, set()).add(r.alias)
    assert got["V Kohli"] == {"V Kohli", "v kohli", "vkohli", "kohli"} and got["Virat Singh"] == {"Virat Singh", "virat singh", "viratsingh", "singh", "v singh"}
    assert got["O'Brien, K."] == {"O'Brien, K.", "o brien k", "obrienk", "k", "o k"}


def test_questions_are_told_or_left_open(spark):
    index = identity.aliases(spark.createDataFrame([(n,) for n in NAMES], "player string"))
    activity = spark.createDataFrame([("R Sharma", 6000), ("RG Sharma", 100), ("V Kohli", 5000)], "player string, activity long")
    asked = spark.createDataFrame([(q,) for q in ("kohli", "KOHLI", "sharma", "r sharma", "dhoni", "x", "", None, "virat")], "query string")
    got = {r.query: (r.player, r.candidates) for r in identity.resolved(asked, index, activity).collect()}
    assert got["kohli"][0] == got["KOHLI"][0] == "V Kohli" and got["dhoni"][0] == "MS Dhoni" and got["virat"][0] == "Virat Singh"
    assert got["sharma"] == (None, "R Sharma|RG Sharma")  # both fit the word; the lead is not enough
    assert got["r sharma"][1].startswith("R Sharma|")
    assert got["x"] == got[""] == got[None] == (None, None)
