"""Walk-forward evaluation: score predictions made before each ball, tune mixtures, and compare models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import COUNTS, LABELS, PROBS, SAMPLE_BUCKET, tier, total
from .decay import decayed, decayed_histories, numbered
from .evidence import CHRONOLOGY, histories, labelled, read
from .models import counts, hierarchical, normalised, rounded, size, smoothed

MODELS = ("global", "phase", "hierarchical")
SMALLEST = 1e-15


#: The histories that the three base models read.
READ = ("batter_bowler", "batter_bowler_type", "bowler_batter_type", "types", "legal_phase", "global")


def trace(balls: DataFrame, cutoff: int, season: int, decay: float = 1.0) -> DataFrame:
    """Each ball of ``season`` with the three base models' probabilities from seasons up to ``cutoff`` and its own earlier balls.

    Predicting with what came before and then learning the ball is the same as exclusive running sums over both spans.
    ``decay``: what a ball weighs less with every ball after it.
    """
    rows = labelled(balls.where((F.col("season_id") <= cutoff) | (F.col("season_id") == season)))
    if decay == 1.0:
        rows = hierarchical(histories(read(rows, *READ), *READ, season=season))
    else:
        rows = hierarchical(decayed_histories(rows, decay, *READ))
    return judged(rows.where(F.col("season_id") == season))


def judged(rows: DataFrame) -> DataFrame:
    """The three base models' probabilities of ``rows`` with the histories READ, ``hierarchical``, a label and a legal phase."""
    phase = [F.when(size(counts("legal_phase")) > 0, c).otherwise(g) for c, g in zip(counts("legal_phase"), counts("global"), strict=True)]
    models = {"global": smoothed(counts("global")), "phase": smoothed(phase), "hierarchical": [F.col(f"hier_{p}") for p in PROBS]}
    probs = [v.alias(f"{m}_{p}") for m, values in models.items() for p, v in zip(PROBS, values, strict=True)]
    return rows.select(*CHRONOLOGY, F.col("label").alias("actual"), "legal_phase", "level", "sample", "reliability", *probs)


def of_actual(values: list[Column]) -> Column:
    """The value of the label that came."""
    chosen = F.when(F.col("actual") == LABELS[0], values[0])
    for x, v in zip(LABELS[1:], values[1:], strict=True):
        chosen = chosen.when(F.col("actual") == x, v)
    return chosen


def scored(values: list[Column]) -> dict[str, Column]:
    """Log loss, Brier score (mean over labels), and whether the label that came is the first or in the first three."""
    own = of_actual(values)
    brier = size([(v - F.when(F.col("actual") == x, 1.0).otherwise(0.0)) ** 2 for x, v in zip(LABELS, values, strict=True)]) / len(LABELS)
    position = F.lit(1)
    for i, (x, v) in enumerate(zip(LABELS, values, strict=True)):
        earlier = F.col("actual").isin(*LABELS[i + 1 :]) if i + 1 < len(LABELS) else F.lit(False)
        position = position + F.when((F.col("actual") != x) & ((v > own) | ((v == own) & earlier)), 1).otherwise(0)
    return {"log_loss": -F.log(F.greatest(own, F.lit(SMALLEST))), "brier": brier, "top1": (position == 1).cast("int"), "top3": (position <= 3).cast("int")}


def long_trace(rows: DataFrame) -> DataFrame:
    """The trace with one row for each base model."""
    keep = [c for c in rows.columns if not any(c.startswith(f"{m}_p_") for m in MODELS)]
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), *(F.col(f"{m}_{p}").alias(p) for p in PROBS)) for m in MODELS)))
    return rows.select(*keep, parts.alias("m")).select(*keep, "m.*")


def metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Sample and mean scores of rows with ``actual`` and the seven probabilities, by ``keys``."""
    values = scored([F.col(p) for p in PROBS])
    named = rows.withColumns(values)
    return named.groupBy(*keys).agg(F.count("*").alias("samples"), *(rounded(F.avg(k)).alias(k) for k in values))


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """By model and confidence bin: predictions, their mean confidence and how many were right; empty bins too."""
    values = [F.col(p) for p in PROBS]
    confidence = F.greatest(*values)
    right = scored(values)["top1"]
    got = rows.select("model", F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int").alias("bin"), confidence.alias("c"), right.alias("r"))
    sums = got.groupBy("model", "bin").agg(F.count("*").alias("n"), rounded(F.avg("c")).alias("confidence"), rounded(F.avg("r")).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(
        rows.sparkSession.createDataFrame([(m,) for m in MODELS], "model string")
    )  # bins * models rows
    zero = {"n": 0, "confidence": 0.0, "accuracy": 0.0}
    return every.join(sums, ["model", "bin"], "left").fillna(zero).select("model", "bin", "n", "confidence", "accuracy")


def sample_buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy(tier("sample", *SAMPLE_BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


def weight_grid(spark: SparkSession, step: float) -> DataFrame:
    """All weights of three models in steps that sum to one."""
    units = round(1 / step)
    i = spark.range(units + 1).select(F.col("id").cast("int").alias("i"))
    rows = i.select("i", F.explode(F.sequence(F.lit(0), units - F.col("i"))).alias("j"))
    return rows.select(
        (F.col("i") / units).alias("w_global"), (F.col("j") / units).alias("w_phase"), ((units - F.col("i") - F.col("j")) / units).alias("w_hierarchical")
    )


def tune(rows: DataFrame, step: float = 0.1) -> DataFrame:
    """Mean log loss and Brier score of every weighting of the base models over the trace.

    The grid has (1/step + 1)(1/step + 2)/2 weightings. A task adds up an array of each score, an element for each weighting, over its rows, and
    gives one row; so the trace is read once, and no row is copied for a weighting. Weights sum to one, so the Brier scores of all
    weightings come from one sum of products of the models' errors.
    """
    units = round(1 / step)
    grid = [(i / units, j / units, (units - i - j) / units) for i in range(units + 1) for j in range(units + 1 - i)]

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights, n = np.array(grid).T, 0
        loss, errors = np.zeros(len(grid)), np.zeros((len(MODELS), len(MODELS)))
        for batch in batches:
            for part in (batch.slice(lo, 4096) for lo in range(0, batch.num_rows, 4096)):
                p = np.stack([part.column(f"{m}_{x}").to_numpy() for m in MODELS for x in PROBS], axis=1).reshape(-1, len(MODELS), len(PROBS))
                at = np.arange(len(p)), slice(None), np.array([LABELS.index(x) for x in part.column("actual").to_pylist()], np.int64)
                loss -= np.log(np.maximum(p[at] @ weights, SMALLEST)).sum(axis=0)
                e = p.copy()
                e[at] -= 1.0
                errors += np.einsum("nil,njl->ij", e, e)
                n += len(p)
        brier = np.einsum("ig,ij,jg->g", weights, errors, weights) / len(LABELS)
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((n, loss, brier), kinds, strict=True)], ["n", "loss", "brier"])

    sums = rows.select("actual", *(f"{m}_{p}" for m in MODELS for p in PROBS)).mapInArrow(summed, "n long, loss array<double>, brier array<double>")
    each = sums.where("n > 0").select("n", F.posexplode(F.arrays_zip("loss", "brier")).alias("i", "s"))  # a row for each task and weighting
    got = each.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s.loss").alias("loss"), F.sum("s.brier").alias("brier"))
    w = F.get(F.array(*(F.struct(*(F.lit(v).alias(f"w_{m}") for v, m in zip(x, MODELS, strict=True))) for x in grid)), F.col("i"))
    scores = (rounded(F.col(c) / F.col("n")).alias(name) for c, name in (("loss", "log_loss"), ("brier", "brier")))
    return got.select(w.alias("w"), *scores).select("w.*", "log_loss", "brier")


def best_weights(tuned: DataFrame) -> DataFrame:
    return tuned.orderBy("log_loss", "brier", F.desc("w_phase"), F.desc("w_hierarchical"), F.desc("w_global")).limit(1)


def leakage_audit(balls: DataFrame, cutoff: int, season: int) -> DataFrame:
    """Whether the last training ball is before the first evaluated one, in chronological order."""
    key = F.struct("season_id", "match_id", "innings", "over_number", "ball_number")
    train, test = F.col("season_id") <= cutoff, F.col("season_id") == season
    found = balls.agg(F.max(F.when(train, key)).alias("last"), F.min(F.when(test, key)).alias("first"), total(train, "train_rows"), total(test, "eval_rows"))
    return found.select("train_rows", "eval_rows", (F.col("last") < F.col("first")).cast("int").alias("no_leak"))


def decayed_counts(balls: DataFrame, decay: float = 0.995, context: str = "global") -> DataFrame:
    """The outcome counts of ``context`` before each ball, each earlier ball weighted by decay ** its age in balls."""
    rows = decayed(numbered(labelled(balls)), context, decay, "d")
    return rows.select(*CHRONOLOGY, "step", *(rounded(F.col(f"d_{c}"), 4).alias(c.replace("n_", "d_")) for c in COUNTS))


def nested_split(cutoff: int, evaluated: int, validation: int | None = None) -> tuple[int, int]:
    """(last season to learn from, season to tune on) inside the seasons up to ``cutoff``; the tuning season comes before the evaluated one."""
    validation = cutoff if validation is None else validation
    if validation >= evaluated:
        raise ValueError(f"the validation season {validation} is not before the evaluated season {evaluated}")
    return validation - 1, validation


def tune_decay(balls: DataFrame, cutoff: int, evaluated: int, decays: tuple[float, ...] = (1.0, 0.995), step: float = 0.05) -> DataFrame:
    """The best weights for each decay on the validation season, in order of preference: scores first, then no decay, then simpler weights."""
    learned, validation = nested_split(cutoff, evaluated)
    runs = [best_weights(tune(trace(balls, learned, validation, d), step)).withColumn("recency_decay", F.lit(float(d))) for d in dict.fromkeys(decays)]
    rows = reduce(DataFrame.unionByName, runs)  # a row for each decay
    order = Window.orderBy("log_loss", "brier", F.abs(1.0 - F.col("recency_decay")), F.desc("w_phase"), F.desc("w_hierarchical"), F.desc("w_global"))
    return rows.withColumn("position", F.row_number().over(order))


#: Mixtures of some of the base models: the weights that may be above zero.
VARIANTS = {
    "global_only": ("global",), "phase_only": ("phase",), "hierarchical_only": ("hierarchical",), "global_phase": ("global", "phase"),
    "phase_hierarchical": ("phase", "hierarchical"), "global_phase_hierarchical": MODELS,
}


def variants(tuned: DataFrame) -> DataFrame:
    """The best weighting of each of VARIANTS among all weightings tried."""
    allowed = [F.when(F.lit(True) if len(v) == len(MODELS) else size([F.col(f"w_{m}") for m in MODELS if m not in v]) == 0, F.lit(n)) for n, v in VARIANTS.items()]
    rows = tuned.select("*", F.explode(F.filter(F.array(*allowed), lambda x: x.isNotNull())).alias("variant"))
    order = Window.partitionBy("variant").orderBy("log_loss", "brier", F.desc("w_phase"), F.desc("w_hierarchical"), F.desc("w_global"))
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def mixed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """The trace ``rows`` with the probabilities of the mixture of the one row of ``weights``: shares, rounded."""
    rows = rows.crossJoin(F.broadcast(weights.select(*(f"w_{m}" for m in MODELS))))  # one row
    rows = rows.withColumns({f"m_{p}": size([F.col(f"w_{m}") * F.col(f"{m}_{p}") for m in MODELS]) for p in PROBS})
    return rows.withColumns({f"mixture_{p}": rounded(v) for p, v in zip(PROBS, normalised([F.col(f"m_{p}") for p in PROBS]), strict=True)})


def report(balls: DataFrame, cutoff: int, evaluated: int, decay: float = 0.995, step: float = 0.05) -> DataFrame:
    """Scores on the evaluated season of the base models, of the mixture tuned on the validation season, and of its decayed twin."""
    learned, validation = nested_split(cutoff, evaluated)
    plain, aged = (mixed(trace(balls, cutoff, evaluated, d), best_weights(tune(trace(balls, learned, validation, d), step))) for d in (1.0, decay))
    probs = [F.col(f"mixture_{p}").alias(p) for p in PROBS]
    rows = long_trace(plain.drop(*(f"{k}_{p}" for k in ("m", "mixture") for p in PROBS))).select("model", "actual", *PROBS)
    rows = rows.unionByName(plain.select(F.lit("calibrated_mixture").alias("model"), "actual", *probs))
    return metrics(rows.unionByName(aged.select(F.lit("time_decayed_mixture").alias("model"), "actual", *probs)), "model")


def deltas(by_model: DataFrame) -> DataFrame:
    """Each model's scores less those of the global one, absolute and relative."""
    base = by_model.where("model = 'global'").select(F.col("log_loss").alias("base_loss"), F.col("brier").alias("base_brier"))
    rows = by_model.crossJoin(F.broadcast(base))  # one row
    return rows.select(
        "model", rounded(F.col("log_loss") - F.col("base_loss")).alias("loss_delta"),
        rounded((F.col("log_loss") - F.col("base_loss")) / F.col("base_loss")).alias("loss_change"),
        rounded(F.col("brier") - F.col("base_brier")).alias("brier_delta"),
    )
