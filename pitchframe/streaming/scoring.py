"""Next-ball models scored on a stream: predict with what has been seen, then learn, by keyed state.

Each ball is an event for every context that the models read (its batter and bowler, their types, ...), and each (context, key) has a state
of its own: a map from label to count. The state begins with the training seasons' counts. A ball's contexts are counted by different
tasks; what they had before the ball comes back as one row each, and those of a micro-batch are gathered by ball, scored, and written under
the batch's number, so that a batch that is done again after a restart replaces its own rows.

Balls come in chronological order from batch to batch; inside a batch they are sorted. Null keys have no history and no state. The state
grows with the keys met, never with the balls; a batch's balls of one key, at most all of the batch, are counted by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.expr import COUNTS, LABELS
from ..operators.evaluate import READ, judged
from ..operators.evidence import CHRONOLOGY, CONTEXTS
from ..operators.models import hierarchical

KEYS = ("context", "key_0", "key_1")
#: What a ball must bring along: its place, the keys of all contexts, its phase and its label.
BALL = tuple(dict.fromkeys((*CHRONOLOGY, *(k for c in READ for k in CONTEXTS[c]), "legal_phase", "label")))
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_context(balls: DataFrame) -> DataFrame:
    """``balls`` (columns BALL) once for each context whose keys are known, with context and the keys as text."""
    pairs = []
    for name in READ:
        keys = [F.col(k).cast("string") for k in CONTEXTS[name]] + [F.lit("")] * (2 - len(CONTEXTS[name]))
        pairs.append(F.struct(F.lit(name).alias("context"), *(k.alias(f"key_{i}") for i, k in enumerate(keys))))
    every = balls.select(*CHRONOLOGY, "legal_phase", "label", F.explode(F.array(*pairs)).alias("k"))
    return every.select(*CHRONOLOGY, "legal_phase", "label", "k.*").where("key_0 IS NOT NULL AND key_1 IS NOT NULL")


def learned(balls: DataFrame) -> DataFrame:
    """The state after ``balls``: context, keys, and the count of each label."""
    return by_context(balls).groupBy(*KEYS).agg(*(F.count(F.when(F.col("label") == x, 1)).alias(c) for x, c in zip(LABELS, COUNTS, strict=True)))


class Counts(StatefulProcessor):
    """Of each ball of a key: the key's counts before it. Then the ball counts."""

    def init(self, handle) -> None:
        label, n = T.StructType([T.StructField("label", T.StringType())]), T.StructType([T.StructField("n", T.LongType())])
        self.counts = handle.getMapState("counts", label, n)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for x, c in zip(LABELS, COUNTS, strict=True):
            if n := int(initialState[c].sum()):
                self.counts.updateValue((x,), (n,))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        known = np.array([self.counts.getValue((x,))[0] if self.counts.containsKey((x,)) else 0 for x in LABELS], np.int64)
        balls = pd.concat(list(rows)).sort_values(list(CHRONOLOGY))
        hits = np.stack([(balls["label"] == x).to_numpy().astype(np.int64) for x in LABELS], axis=1)
        before = known + np.cumsum(hits, axis=0) - hits
        for x, old, new in zip(LABELS, known.tolist(), (before[-1] + hits[-1]).tolist(), strict=True):
            if new != old:
                self.counts.updateValue((x,), (new,))
        out = balls[[*CHRONOLOGY, "legal_phase", "label", "context"]].reset_index(drop=True)
        yield out.assign(**{c: before[:, i] for i, c in enumerate(COUNTS)})

    def close(self) -> None:
        pass


def counted(balls: DataFrame, state: DataFrame) -> DataFrame:
    """A row for each ball of the stream ``balls`` (columns BALL) and context: the counts before it. ``state``: of ``learned``."""
    rows = by_context(balls)
    place = [f for f in rows.schema if f.name in (*CHRONOLOGY, "legal_phase", "label")]
    out = T.StructType([*place, T.StructField("context", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return rows.groupBy(*KEYS).transformWithStateInPandas(Counts(), out, "Append", "None", initialState=state.groupBy(*KEYS))


def gathered(rows: DataFrame) -> DataFrame:
    """The rows of ``counted`` as one for each ball, with the histories as columns; a context without a row has none."""
    columns = [F.coalesce(F.max(F.when(F.col("context") == name, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for name in READ for c in COUNTS]
    return rows.groupBy(*CHRONOLOGY, "legal_phase", "label").agg(*columns)


def score(balls: DataFrame, state: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts scoring the stream ``balls`` into the Parquet table ``out``: of each ball the three models' probabilities before it."""
    balls.sparkSession.conf.set(STORE, ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        judged(hierarchical(gathered(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counted(balls, state).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")
