"""Quality classifier: Gaussian-kernel ridge regression on document statistics, calibrated.

Random Fourier features approximate the kernel. Every partition of labelled rows sums its part of the normal
equations (``features``**2 numbers, whatever its rows), Spark adds the parts, and the driver solves one system of
``features`` unknowns. Scores of the labelled rows, counted in ``BINS`` equal bins, fit an isotonic calibration.

Defined results: null or empty text has the statistics of an empty text and a score like any other; rows whose
label is null teach nothing; with no labels every score is 0.5, and with one class it is that class; repeated
rows get equal scores; equal raw scores have equal calibrated ones; a null doc_id is neither held out nor learned from
(``held_out`` is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

STATISTICS = (
    "log_chars", "log_words", "word_chars", "lower", "upper", "digit", "space", "stop", "symbol", "bar", "bang",
    "other", "new_words", "new_lines", "line_words", "packed", "longest_word", "top_word",
)
BINS = 1000


@lru_cache(1)
def _kinds():
    """The kind of each code point below 2**16: 0 lower, 1 upper, 2 digit, 3 space, 4 .,;:?'"- 5 symbol, 6 |, 7 !, 8 other."""
    import numpy as np

    kinds = np.full(1 << 16, 8, np.int64)
    for c in range(1 << 16):
        s = chr(c)
        if s.isupper():
            kinds[c] = 1
        elif s.isalpha():
            kinds[c] = 0
        elif s.isdigit():
            kinds[c] = 2
        elif s.isspace():
            kinds[c] = 3
    for s, k in ((".,;:?'\"-", 4), ("#$%&*+/<=>@\\^_`~{}[]", 5), ("|", 6), ("!", 7)):
        for c in s:
            kinds[ord(c)] = k
    return kinds


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS, of the whole text."""
    import zlib

    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shares = np.bincount(_kinds()[np.minimum(codes, 0xFFFF)], minlength=9) / max(1, len(codes))
    words, lines = text.lower().split(), [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(words))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0,
        *shares.tolist(), len(counts) / n, len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        len(zlib.compress(raw, 1)) / max(64, len(raw)), float(np.log1p(lengths.max())) if len(words) else 0.0,
        max(counts.values(), default=0) / n,
    ]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``stats`` (an array, see STATISTICS) for each row of ``docs``."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            stats = pa.array([statistics(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), stats], [*keep, "stats"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(measure, f"{kinds}, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: object
    scale: object
    directions: object
    phases: object
    weights: object
    edges: object  #: calibration: raw scores, rising
    values: object  #: and the chance of label 1 at each

    def raw(self, stats):
        return self.mapped(stats) @ self.weights

    def mapped(self, stats):
        import numpy as np

        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, stats):
        import numpy as np

        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def pooled(scores, ones, counts):
    """Isotonic regression by pooling adjacent violators: the rising sequence nearest to ones / counts."""
    blocks: list[list[float]] = []  # ones, counts, scores
    for s, a, n in zip(scores, ones, counts, strict=True):
        blocks.append([a, n, [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    edges, values = [], []
    for a, n, inside in blocks:
        for s in sorted({inside[0], inside[-1]}):
            edges.append(s)
            values.append(a / n)
    return edges, values


def fit(labelled: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1.0, seed: int = 5) -> QualityModel:
    """The model of all rows of ``labelled`` (stats, label 0 or 1)."""
    import numpy as np

    k = len(STATISTICS)
    rows = labelled.where("label IS NOT NULL").select("stats", F.col("label").cast("double").alias("label"))
    moments = rows.agg(
        F.count("*").alias("n"),
        *(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))),
    )
    got = moments.first()
    random = np.random.default_rng(seed)
    directions, phases = random.normal(0, 1 / width, (k, features)), random.uniform(0, 2 * np.pi, features)
    if not got["n"]:
        return QualityModel(np.zeros(k), np.ones(k), directions, phases, np.zeros(features + 1), [0.0], [0.5])
    mean = np.array([got[f"m{i}"] for i in range(k)])
    scale = np.maximum(np.array([got[f"s{i}"] for i in range(k)]), 1e-6)
    start = QualityModel(mean, scale, directions, phases, np.zeros(features + 1), [0.0], [0.5])
    shipped = labelled.sparkSession.sparkContext.broadcast(start)

    def add(batches: Iterator) -> Iterator:
        """One row for each row of the partition's normal equations, its right-hand side last."""
        import pyarrow as pa

        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if not len(batch):
                continue
            x = shipped.value.mapped(np.array(batch.column("stats").to_pylist()))
            y = batch.column("label").to_numpy()
            total[:, :-1] += x.T @ x
            total[:, -1] += x.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "part"]
        )

    def combine(key: tuple, group):
        import pandas as pd

        return pd.DataFrame({"i": [key[0]], "part": [sum(np.frombuffer(p) for p in group["part"]).tobytes()]})

    parts = rows.mapInArrow(add, "i int, part binary").groupBy("i").applyInPandas(combine, "i int, part binary")
    system = np.array([np.frombuffer(r["part"]) for r in parts.orderBy("i").collect()])  # features + 1 rows
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    fitted = QualityModel(mean, scale, directions, phases, weights, [0.0], [0.5])
    shipped_fit = labelled.sparkSession.sparkContext.broadcast(fitted)

    def bins(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                raw = shipped_fit.value.raw(np.array(batch.column("stats").to_pylist()))
                at = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label"), pa.array(raw)], ["bin", "label", "raw"])

    counted = (
        rows.mapInArrow(bins, "bin int, label double, raw double")
        .groupBy("bin")
        .agg(F.sum("label").alias("ones"), F.count("*").alias("n"), F.avg("raw").alias("raw"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    edges, values = pooled(*([r[c] for r in counted] for c in ("raw", "ones", "n")))
    return QualityModel(mean, scale, directions, phases, weights, edges, values)


def predict(docs: DataFrame, model: QualityModel, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` and the score, named ``name``, for each row of ``docs``, in one pass over the texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    if name in keep:
        raise ValueError(f"the column {name} is there already; give the score another name")

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                stats = np.array([statistics(t or "") for t in batch.column("text").to_pylist()])
                columns = [*(batch.column(k) for k in keep), pa.array(shipped.value.score(stats))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, name])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(scored, f"{kinds}`{name}` double")


def score(stats: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """``keep`` and ``score`` for each row of ``stats``."""
    shipped = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                got = shipped.value.score(np.array(batch.column("stats").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(got)], [*keep, "score"])

    kinds = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keep)
    return stats.select(*keep, "stats").mapInArrow(scored, f"{kinds}, score double")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows to learn from: labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    return stats.select("doc_id", "stats").join(known, "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(measured(table(spark, sf_dir, "documents"), "doc_id"), "quality-statistics")
    model = fit(labelled(stats, table(spark, sf_dir, "labels")))
    found = score(stats, model, "doc_id")
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
