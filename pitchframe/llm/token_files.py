"""Token-ID output: documents as compressed binary token files, in ascending doc_id order, and back.

A token file set is a folder of Parquet files whose rows are segments: ``part_id`` and ``segment_no`` give
their order, ``n_docs`` and ``n_ids`` their size, and ``payload`` is the binary segment of ``coder.py``
(whole documents; independently reset, checksummed blocks). Spark's writer commits the files, so a lost
executor leaves no half-written one.

Defined results: null text is an empty document (its end id alone); repeated rows are kept, equal doc_ids in
the order of their texts; null doc_ids are refused; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, partitions, table, texts

SEGMENTS = "part_id int, segment_no long, n_docs long, n_ids long, payload binary"


def encode_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    spaced: bool = True,
    end_id: int = 0,
    block: int = 2048,
    segment_ids: int = 4_000_000,
) -> None:
    """Write the token files of ``docs`` to ``path``. A segment has whole documents of about ``segment_ids`` ids."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .coder import encode_segment
        from .tokens import encoder

        words, end, part = encoder(vocabulary, spaced), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        held: list[tuple[int, bytes]] = []
        state = {"ids": 0, "segment": 0}

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for _, x in held], np.int64)
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            payload = encode_segment(np.array([d for d, _ in held], np.int64), lengths, ids, block)
            row = [[part], [state["segment"]], [len(held)], [len(ids)], [payload]]
            held.clear()
            state["ids"], state["segment"] = 0, state["segment"] + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                ["part_id", "segment_no", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            for lo in range(0, len(batch), 500):
                piece = batch.slice(lo, 500)
                for d, ids in zip(
                    piece.column("doc_id").to_pylist(), words.encode(piece.column("text").to_pylist()), strict=True
                ):
                    held.append((d, ids + end))
                    state["ids"] += len(ids) // 4 + 1
                    if state["ids"] >= segment_ids:
                        yield segment()
        if held:
            yield segment()

    known = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("doc_id is null"))).otherwise(F.col("doc_id"))
    rows = texts(docs).withColumn("doc_id", known.cast("long"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


def decode_files(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32) of every document.

    ``checksums``: in place of ids, ids_crc32, their unsigned crc32. A damaged segment or block ends the job.
    """
    last = "ids_crc32" if checksums else "ids"

    def decode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from .coder import decode_segment

        for batch in batches:
            for i in range(len(batch)):
                doc_ids, lengths, ids = decode_segment(batch.column("payload")[i].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if checksums:
                    cuts = zip(starts.tolist(), ends.tolist(), strict=True)
                    own = pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64())
                else:
                    offsets = pa.py_buffer((4 * np.append(starts, len(ids))).astype("<i4"))
                    own = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [None, offsets, pa.py_buffer(ids)])
                before = starts + batch.column("segment_start")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(before), pa.array(lengths), own], ["doc_id", "start", "n_tokens", last])

    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part_id", "segment_no", "n_ids")
    # One row for each partition of the writing job.
    parts = sizes.groupBy("part_id").agg(F.sum("n_ids").alias("part_ids"))
    earlier = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part_id", F.coalesce(F.sum("part_ids").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part_id").select(
        "part_id",
        "segment_no",
        (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("segment_start"),
    )
    # Starts meet the coded segments: the decoded ids are not shuffled.
    placed = segments.join(starts, ["part_id", "segment_no"]).select("segment_start", "payload")
    return placed.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last} {'long' if checksums else 'binary'}")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    encode_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return decode_files(spark, path, checksums=True)
