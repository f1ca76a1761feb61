"""The stream of three models, over many batches and a restart, against the trace of the whole season."""

import os

from pyspark.sql import functions as F

from pitchframe.operators import evaluate
from pitchframe.operators.evidence import CHRONOLOGY, labelled
from pitchframe.sources.adapter import deliveries
from pitchframe.streaming import scoring

CUTOFF, SEASON = 1994, 1996


def test_a_stream_restarted_once_gives_the_rows_of_the_trace(spark, tmp_path):
    balls = deliveries(spark, "/root/testdata/sf0.001")
    # Some balls have no bowler type and no batter.
    balls = balls.withColumn("batter", F.when(F.col("source_row_number") % 17 != 0, F.col("batter")))
    rows = labelled(balls).select(*scoring.BALL)
    season = rows.where(F.col("season_id") == SEASON)
    matches = sorted(r[0] for r in season.select("match_id").distinct().collect())
    folder, out, state = tmp_path / "balls", str(tmp_path / "out"), scoring.learned(rows.where(F.col("season_id") <= CUTOFF))
    folder.mkdir()

    def add(some, at):
        for i, m in enumerate(some):
            season.where(F.col("match_id") == m).coalesce(1).write.parquet(str(tmp_path / f"{at}-{i}"))
            part = next(f for f in os.listdir(tmp_path / f"{at}-{i}") if f.endswith(".parquet"))
            target = folder / f"{m}.parquet"
            os.rename(tmp_path / f"{at}-{i}" / part, target)
            os.utime(target, (1_000_000 + m, 1_000_000 + m))

    def run():
        stream = spark.readStream.schema(season.schema).option("maxFilesPerTrigger", 5).parquet(str(folder))
        query = scoring.score(stream, state, out, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query

    add(matches[:12], "a")
    run()
    add(matches[12:], "b")
    last = run()
    assert last.lastProgress["batchId"] >= 4
    want = evaluate.trace(balls, CUTOFF, SEASON)
    got = scoring.scored(spark, out)
    assert got.columns == want.columns and got.count() == want.count() > 100
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.select(*CHRONOLOGY).distinct().count() == got.count()
