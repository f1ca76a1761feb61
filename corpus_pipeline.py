"""The corpus pipeline: language ID, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.

Defined results: null and empty texts go in the first stage, as they have no language; a very long text is one row in memory and is
worked on whole; rows, not ids, are kept or go, so equal ids hide nothing; a null doc_id is kept like any other; of equal rows
one stays; an empty table gives no rows at every stage; columns beyond those of documents are carried along up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import language, packing, pii, quality, simhash
from pitchframe.llm.shared import free_name, table, written

#: Documents below this chance of being of good quality go.
LEAST_QUALITY = 0.3
NO_ID = 1 << 63  #: in place of a null doc_id: behind all others
DIGESTS = 10**18


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: those without letters."""
    model = language.learn(table(spark, sf_dir, "documents").where(~F.coalesce(language.held_out(), F.lit(False))))
    names = tuple(free_name(docs, c) for c in ("lang_pred", "score", "languages"))
    found = language.predict(docs, model, *docs.columns, names=names)
    return found.where(F.col(names[0]) != language.UNDETERMINED).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the classifier, fitted on the labelled documents of this stage's input, scores too low."""
    labelled = quality.labelled(quality.measured(docs, "doc_id"), table(spark, sf_dir, "labels"))
    model, name = quality.fit(written(labelled, "labelled-statistics")), free_name(docs, "score")
    return quality.predict(docs, model, *docs.columns, name=name).where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarities of 0.8 or more, over sets of five words, one row stays: that of the smallest
    doc_id, null after all others, and of the smallest digest among equal ids. Rows equal in both are copies, of which one stays."""
    own, mark = (free_name(docs, c) for c in ("identity", "mark"))
    # Ids and, behind them, eighteen digits of the text's digest, as one number, which is aggregated in place.
    number = F.expr(f"coalesce(cast(doc_id AS decimal(19, 0)), {NO_ID}BD) * {DIGESTS}BD + pmod(xxhash64(text), {DIGESTS}L)")
    rows = docs.withColumn(own, number.cast("decimal(38, 0)"))
    found = simhash.similar_documents(rows.select(F.col(own).alias("doc_id"), "text"), similarity=0.8, shingle=5)
    held = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
    # Only rows that go, or that are there several times, have a mark; all others pass without a second look.
    goes = F.col("doc_id") != F.col("first")
    marks = held.where(goes | (F.col("n") > 1)).select(F.col("doc_id").alias(own), F.when(goes, "goes").otherwise("repeated").alias(mark))
    marked = rows.join(marks, own, "left").where(F.coalesce(F.col(mark), F.lit("")) != "goes")
    single = marked.where(F.col(mark).isNull()).select(*docs.columns)
    whole = F.struct(*docs.columns)
    one = marked.where(F.col(mark) == "repeated").groupBy(own).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias(mark))  # in each task first
    return single.unionByName(one.select(f"{mark}.*"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms under the session's key."""
    kept = pii.pseudonymise(docs, pii.session_key(spark))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_languages),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_first_copies),
    ("PII", hide_personal_data),
    ("packing", pack),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
