"""Streams of events and of replayed deliveries; the same functions run on static tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import COUNTS, LABELS, outcome


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and their values by hour and type; on a stream, events later than ``late`` are left out."""
    rows = _timed(events, late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("hour"), "event_type", "n", "total"
    )


def first_of_each(events: DataFrame, *keys: str, late: str = "2 hours") -> DataFrame:
    """The first event of each key; a stream forgets keys older than ``late``."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return _timed(events, late).dropDuplicatesWithinWatermark(list(keys))


def replay(balls: DataFrame, *keys: str) -> DataFrame:
    """Test, then train: each ball of a stream with the smoothed probabilities of its key before it, and then its label.

    The state of a key is seven counts. Balls of one key in one batch are taken in chronological order.
    """
    order = ["season_id", "match_id", "innings", "over_number", "ball_number", "source_row_number"]
    rows = balls.select(*dict.fromkeys((*keys, *order)), outcome().alias("label"))

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        counts = np.array(state.get if state.exists else [0] * len(LABELS), dtype="int64")
        rows = pd.concat(list(frames)).sort_values(order)
        hits = np.stack([(rows["label"] == x).to_numpy().astype("int64") for x in LABELS], axis=1)
        before = counts + np.cumsum(hits, axis=0) - hits
        state.update(tuple(int(x) for x in before[-1] + hits[-1]))
        out = rows[[*dict.fromkeys((*keys, *order)), "label"]].reset_index(drop=True)
        yield out.assign(**{c: before[:, i] for i, c in enumerate(COUNTS)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    counted = ", ".join(f"{c} long" for c in COUNTS)
    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, {counted}", counted, "append", "NoTimeout")
