"""Importance resampling towards a target distribution: documents are drawn whose words are like those of a target table.

Words and runs of words are hashed to buckets. A bucket's gain says how much likelier the target uses it than the documents
do; a document's weight sums the gains of its features, scored against one array of all gains; its score adds Gumbel noise
that depends on its id alone, so that the highest scores are a draw without replacement by weight.

The highest scores are found without a sort: scores are integers, so a histogram of them, counted before the shuffle, has all
that ranks need. It has two levels, blocks of ``2 ** BLOCK`` scores and the scores inside; suffix sums of the counts
give each score the number of higher ones and tell the cutoff. Only rows from the cutoff up are dealt by score and numbered by
doc_id inside it.

Defined results: null and empty texts have no features and weight 0; a very long text is one row in memory, as it is in the table;
of equal scores the smaller doc_id comes first, null first of all, and rows equal in both are drawn one by one; a null
doc_id's noise is that of an empty id; with nothing in the target all gains compare with an even spread; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, texts, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 12  #: bits of a score inside its block
SHORT = 20  #: words that a document needs to be drawn


def words(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, with A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def buckets(found: Column, runs: int, n_buckets: int) -> Column:
    """The bucket of each run of 1 to ``runs`` of the words, repeats included."""
    bucket = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(n_buckets)).cast("short" if n_buckets <= 1 << 15 else "int")

    def of_length(n: int) -> Column:
        spots = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: bucket(F.array_join(F.slice(found, i, F.lit(n)), " ")))

    return F.concat(F.transform(found, bucket), *(of_length(n) for n in range(2, runs + 1)))


def counted(featured: DataFrame, name: str) -> DataFrame:
    return featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(featured: DataFrame, target: DataFrame, n_buckets: int) -> list[int]:
    """Of each bucket, 1000 times the log of how much likelier the target has it: a list of ``n_buckets``."""
    s, t = counted(featured, "s"), counted(target, "t")
    both = featured.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    held = written(both, "bucket-counts")
    sums = held.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * float(sums["s"] + n_buckets) / ((F.col("s") + 1).cast("double") * float(sums["t"] + n_buckets))
    rows = held.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()  # a row for each bucket
    return [r["gain"] for r in sorted(rows, key=lambda r: r["bucket"])]


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int, of: int) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...) with rank: 1, 2, 3... of the ``share / of`` highest scores; null beyond."""
    able = scored.where(F.col("n_words") >= SHORT)
    histogram = written(able.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("score", BLOCK)), "score-counts")
    # A row for each block of scores: few, however many documents there are.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = histogram.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("higher"))
    wanted = share * (histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) // of
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    reached = histogram.join(blocks.where(F.col("higher") < wanted).select("block", "higher"), "block")
    offsets = reached.select("score", (F.col("higher") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("higher")).where(F.col("higher") < wanted)
    offsets = written(offsets, "score-offsets")
    cutoff = offsets.agg(F.min("score").alias("score")).first()["score"]
    drawn = (F.col("n_words") >= SHORT) & (F.col("score") >= cutoff) if cutoff is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    first = scored.where(drawn).withColumn("_place", place).join(offsets, "score").withColumn("rank", F.col("_place") + F.col("higher"))
    first = first.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return first.select(*scored.columns, "rank").unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, of: int = 100, runs: int = 1, n_buckets: int = 10000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every document; ``target`` has the texts to be like."""
    def featured(rows: DataFrame, *keep: str) -> DataFrame:
        rows = rows.select(*keep, words(F.col("text")).alias("words"))
        return rows.select(*keep, F.size("words").cast("long").alias("n_words"), buckets(F.col("words"), runs, n_buckets).alias("features"))

    mine = written(featured(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"), "features")
    found = gains(mine, featured(target), n_buckets)
    by_bucket = F.from_json(F.lit(json.dumps(found)), "array<bigint>")  # folded to one array before the job starts
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, b: total + F.get(by_bucket, b.cast("int")))
    scored = mine.select("doc_id", F.size("features").cast("long").alias("n_features"), "n_words", weight.alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(seed))
    return ranked(written(scored, "scores"), share, of)


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: crc32 is a fold over a word's bytes with the table of its polynomial; each word is hashed once.
RESAMPLING_SQL = """
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS c FROM range(256) r(i))),
mine AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
theirs AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark),
counted AS MATERIALIZED (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM mine) GROUP BY ALL),
vocabulary AS MATERIALIZED (
  SELECT word, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(strlen(word)), lambda k: ('0x' || hex(word)[2 * k + 1 : 2 * k + 2])::UBIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM counted UNION ALL SELECT word FROM theirs)), polynomial),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM counted JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM theirs JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS total_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS total_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (total_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (
  SELECT row, sum(n * gain)::BIGINT AS weight FROM counted JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM mine LEFT JOIN weights USING (row)),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS wanted FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END::BIGINT AS rank FROM scored LEFT JOIN able USING (row)
"""
