"""Packing: whole documents into training sequences of at most ``capacity`` tokens.

A document's ids are cut at multiples of the capacity. Full pieces are sequences of their own; the
rest of each document is packed by first-fit decreasing, with a tournament tree over the capacity left
in each bin, independently in randomised groups of documents. Only lengths and checksums are shuffled.

Groups are hashes of a row's doc_id and text, about ``group_size`` documents each however
large the corpus, so no source, key or group of copies fills one of them. Rows equal in both share a group; were there
very many of them, that one group would grow (its rows are a few numbers each).

Defined results: null text is an empty document (its end id alone); repeated rows are packed once each; a null doc_id is
kept; an empty table gives no rows; other columns are ignored; equal lengths are packed in the order of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, texts

PIECES = "doc_id long, doc_tokens long, full array<long>, rest long, rest_crc long, salt long"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, in the order given: each goes, largest first, to the first bin that has room.

    ``tree[k]`` is the most room in any bin below node k; the leaves are the bins.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda k: -sizes[k]):
        node, size = 1, sizes[i]
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(
    docs: DataFrame,
    vocabulary: str,
    spaced: bool = False,
    end_id: int = 1,
    capacity: int = 2048,
    group_size: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    ``vocabulary``: path of a file of the tokenizers library, present on every worker.
    """

    def measure(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        from .tokens import encoder

        words, end = encoder(vocabulary, spaced), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = {k: [] for k in ("doc_tokens", "full", "rest", "rest_crc")}
            for ids in words.encode(batch.column("text").to_pylist()):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                rows["doc_tokens"].append(n)
                rows["full"].append([zlib.crc32(ids[4 * i : 4 * (i + capacity)]) for i in range(0, whole, capacity)])
                rows["rest"].append(n - whole)
                rows["rest_crc"].append(zlib.crc32(ids[4 * whole :]))
            arrays = [pa.array(v, pa.list_(pa.int64()) if k == "full" else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays, batch.column("salt")], ["doc_id", *rows, "salt"]
            )

    def fill(key, group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, [("doc_id", "ascending"), ("salt", "ascending")]))
        tokens, rest, crc = (group.column(c).to_numpy() for c in ("doc_tokens", "rest", "rest_crc"))
        # The last piece of each document is packed; the full ones follow as sequences of their own.
        short = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[short].tolist(), capacity)
        whole = group.column("full").combine_chunks()
        sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bins, offsets = np.array(bins, np.int64), np.array(offsets, np.int64)
        after = int(bins.max(initial=-1)) + 1
        filled = np.bincount(bins, rest[short], minlength=after).astype(np.int64)
        n = len(owner)
        columns = {
            "start": [tokens[short] - rest[short], capacity * nth], "length": [rest[short], np.full(n, capacity)],
            "ids_crc32": [crc[short], whole.flatten().to_numpy(zero_copy_only=False)], "doc_tokens": [tokens[short], tokens[owner]],
            "sequence_id": [(int(key[0].as_py()) << 32) + bins, (int(key[0].as_py()) << 32) + after + np.arange(n)],
            "offset": [offsets, np.zeros(n)], "sequence_tokens": [filled[bins], np.full(n, capacity)],
        }
        made = {k: pa.array(np.concatenate(v).astype(np.int64)) for k, v in columns.items()}
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(np.concatenate([short, owner]))), **made})

    groups = max(1, -(-docs.count() // group_size))
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    sized = rows.withColumn("salt", F.xxhash64("text", "doc_id", F.lit(seed))).mapInArrow(measure, PIECES)
    # At least as many partitions as groups would need; a group never spans two.
    return (
        sized.withColumn("group", F.pmod("salt", F.lit(groups)))
        .repartition(max(1, min(groups, partitions(docs.sparkSession))), "group")
        .groupBy("group")
        .applyInArrow(fill, PACKED)
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
