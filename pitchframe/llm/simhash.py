"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64-bit SimHash of word shingles. Two documents link if their fingerprints differ in at most
``distance`` bits; a document's component is the smallest doc_id reachable over links.

The index. Equal fingerprints are one entry. Each is keyed by its bits under several masks, and each key's fingerprints are
searched alone. The masks are the choices of ``blocks`` of ``blocks + distance`` blocks of bits, one of which two linked
fingerprints must agree on. Masks get longer with the logarithm of the number of fingerprints, which keeps groups small. Inside a group they are sorted by Gray rank, so
neighbours share bits; each node above holds the bits its members all set and the bits that any sets. Two nodes
are compared level by level: they are pruned as a whole once the bits on which their shared patterns differ exceed the
distance, and linked as a whole, without listing pairs, once no bits on which their members can differ exceed it.
A key with more than ``most`` fingerprints is dealt to pairs of chunks, each searched by a task of its own.
A task returns a forest of its links, not the pairs; Spark joins the forests by alternating star contractions.

Defined results: null text is an empty one, and texts without words have fingerprint zero, linked like any other;
repeated rows are each returned; rows with a null doc_id are fingerprinted but name no component (null if alone);
an empty table gives no rows; other columns are ignored.

``similar_documents`` links by the similarity of the shingle sets themselves. Fingerprints of sets 0.8 alike differ in some 19 of
128 bits and up to 44, too many for keys of bits alone; keys of least values bring them together, the index compares them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, table, texts, written

PIECE = 50_000  #: shingles whose bits are counted at once
FAN = 8  #: children of a node
PAIRS = 1 << 18  #: node pairs compared at once
HOT = 10_000  #: a key is sent by broadcast if it has over a HOT-th of the rows
ROWS = 4  #: least values in a key of ``similar_documents``
MISS = 1e-5  #: the chance that two sets just as alike as asked for have no key in common
TOGETHER = 256  #: comparisons for which a set is sent once


def shingle_hashes(text: str, shingle: int):
    """The XXH64 values of the text's shingles, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def simhash_of(hashes, words: int = 1) -> list[int]:
    """A SimHash of 64 bits a word: bit k is set if it is in over half of ``hashes``. Words after the first mix the hashes anew."""
    import numpy as np

    out = []
    for n in range(words):
        total = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), PIECE):
            part = hashes[lo : lo + PIECE]
            if n:
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                part ^= part >> np.uint64(32)
            total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        over = np.packbits(2 * total > len(hashes), bitorder="little")
        out.append(int(over.view("<u8")[0]))
    return out


def fingerprint(text: str, shingle: int = 4, words: int = 1) -> list[int]:
    """The text's SimHash, repeated shingles counted each time."""
    return simhash_of(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id and w0, w1, ... (the fingerprint's words as signed longs) for each row of ``docs``."""
    names = [f"w{n}" for n in range(words)]

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, shingle, words) for t in batch.column("text").to_pylist()]
            fps = np.array(found, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(fps[:, n].copy()) for n in range(words))], ["doc_id", *names]
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    return texts(docs).mapInArrow(hashed, schema)


def _cuts(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``parts`` blocks of the 64 bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def exact_masks(n: int, distance: int, group_size: int) -> list[int]:
    """Bits to key by so that any two fingerprints within ``distance`` agree on all bits of at least one mask."""
    blocks = 1  # so many that a key's expected share of n evenly spread fingerprints is at most group_size
    while blocks < 4 and n / 2 ** (64 * blocks // (blocks + distance)) > group_size:
        blocks += 1
    cuts = _cuts(blocks + distance)
    return [sum(((1 << size) - 1) << at for at, size in choice) for choice in combinations(cuts, blocks)]


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """The columns of ``fps``, choice (which mask) and key (the first word's bits under it): one row for each mask."""
    rows = [
        F.struct(F.lit(n).alias("choice"), F.col("w0").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
        for n, m in enumerate(masks)
    ]
    return fps.select("*", F.explode(F.array(*rows)).alias("k")).select(*fps.columns, "k.choice", "k.key")


def search_groups(fps, group, distance: int, tight: int, label_of=None, visit=None):
    """(root, pairs): of each fingerprint (row of uint64 words) the position of one that ``tight`` links lead to inside its
    group, and the pairs of positions within ``distance`` bits whose roots differ.

    ``group``: rising numbers. Inside a group rows are reordered by the Gray rank of the first word. ``label_of``: rows with
    equal labels are linked already, are sorted together, and nodes of one label are not compared with each other.
    ``visit``: is called with pairs, at most ``PAIRS`` at a time, in place of returning them.
    """
    import numpy as np

    known = np.arange(len(fps)) if label_of is None else np.unique(label_of, return_inverse=True)[1]

    rank = fps[:, 0].copy()  # the Gray rank: the number whose Gray code the fingerprint is
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    order = np.lexsort((rank, group) if label_of is None else (rank, known, group))
    values, groups, known = fps[order], group[order], known[order]
    n = len(values)
    # levels[k]: (bits set by all, bits set by any, group, first member, members, least and largest label) of its nodes;
    # level 0 has the fingerprints.
    levels = [(values, values, groups, np.arange(n), np.ones(n, np.int64), known, known)]
    while True:
        every, some, owner, first, size, least, largest = levels[-1]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts = np.diff(np.append(starts, len(owner)))
        if counts.max() == 1:
            break
        at = np.flatnonzero((np.arange(len(owner)) - np.repeat(starts, counts)) % FAN == 0)
        every, some = np.bitwise_and.reduceat(every, at, axis=0), np.bitwise_or.reduceat(some, at, axis=0)
        least, largest = np.minimum.reduceat(least, at), np.maximum.reduceat(largest, at)
        levels.append((every, some, owner[at], first[at], np.add.reduceat(size, at), least, largest))
    label = np.arange(n)

    def link(a, b) -> None:
        """Join members a[i] and b[i]; labels always lead to a member with the same or a smaller label."""
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label[:] = shorter

    def bits(x):
        return np.bitwise_count(x).sum(axis=1, dtype=np.int64)

    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo, loose = [(top, roots, roots)], [np.zeros((2, 0), np.int64)]
    most = PAIRS // (FAN * FAN)
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS:
            todo += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
            continue
        every, some, _, first, size, least, largest = levels[level]
        if label_of is not None:
            other = (least[a] != largest[a]) | (least[b] != largest[b]) | (least[a] != least[b])
            a, b = a[other], b[other]
        apart = bits((every[a] & ~some[b]) | (every[b] & ~some[a]))
        near = apart <= distance
        a, b, apart = a[near], b[near], apart[near]
        if not level:
            close = apart <= tight
            link(a[close], b[close])
            rest = ~close & (label[a] != label[b])
            if visit is None:
                loose.append(np.stack([a[rest], b[rest]]))
            elif rest.any():
                visit(order[a[rest]], order[b[rest]])
            continue
        whole = bits((some[a] | some[b]) & ~(every[a] & every[b])) <= tight
        for x in (a[whole], b[whole]):  # all members of the node are within the distance of its first
            heads = np.repeat(first[x], size[x])
            link(heads, heads + np.arange(len(heads)) - np.repeat(np.cumsum(size[x]) - size[x], size[x]))
        link(first[a[whole]], first[b[whole]])
        a, b = a[~whole], b[~whole]
        # Children of a node: up to FAN nodes of the level below, from the one with the same first member.
        below = levels[level - 1]
        child = np.searchsorted(below[3], first)
        children = np.diff(np.append(child, len(below[3])))
        i, j = np.divmod(np.arange(FAN * FAN), FAN)
        for lo in range(0, len(a), most):
            p, q = a[lo : lo + most, None], b[lo : lo + most, None]
            x, y = child[p] + i, child[q] + j
            real = (i < children[p]) & (j < children[q]) & ((p != q) | (x <= y))  # a node with itself: each pair once
            todo.append((level - 1, x[real], y[real]))
    pairs = np.concatenate(loose, axis=1)
    pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
    root = np.empty(n, np.int64)
    root[order] = order[label]
    return root, order[pairs]


def linked(
    fps: DataFrame, masks: list[int], distance: int, tight: int, most: int = 2048, task_rows: int = 1_000_000
) -> DataFrame:
    """(a, b, sure): pairs of ids of ``fps`` (id, w0, w1, ...: distinct fingerprints) that share a key.

    Those within ``tight`` bits come as a forest for each group searched, marked ``sure``; those further apart, up to
    ``distance`` bits, as pairs, unless sure links join them already.
    """
    words = [c for c in fps.columns if c != "id"]
    rows = keyed(fps, masks)
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["choice", "key"]).withColumn("chunks", F.ceil(F.col("n") / most).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = rows.withColumn("own", own).withColumn("other", other).select(
        "id", *words, "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def found(got: list) -> pa.RecordBatch:
            columns = [np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("choice", "key", "i", "j")]
            ids = np.concatenate([b.column("id").to_numpy() for b in got])
            values = np.stack([np.concatenate([b.column(w).to_numpy() for b in got]) for w in words], axis=1).view(np.uint64)
            new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
            root, loose = search_groups(values, np.cumsum(new), distance, tight)
            tied = np.flatnonzero(root != np.arange(len(root)))
            a, b = np.concatenate([ids[root[tied]], ids[loose[0]]]), np.concatenate([ids[tied], ids[loose[1]]])
            sure = np.arange(len(a)) < len(tied)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"]
            )

        # A partition holds whole groups, each of at most 2 * most fingerprints, one after the other.
        held: list = []
        for batch in batches:
            if len(batch):
                held.append(batch)
        if held:
            yield found(held)

    keys = ["choice", "key", "i", "j"]
    spark, n = fps.sparkSession, len(masks)
    parts = max(partitions(spark), -(-fps.count() * n // task_rows))
    dealt = pairs.repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(search, "a long, b long, sure boolean").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) of every node of ``edges`` (two long columns): the smallest node of its component.

    Alternating large-star and small-star contractions; each round's edges are a table in the shared folder.
    """
    a, b = edges.columns
    links = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = written(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = now
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def joined(rows: DataFrame, one: DataFrame, *keys: str) -> DataFrame:
    """The inner join of ``rows`` with ``one``, which has each key once and in ``n`` how many of ``rows`` have it.

    Keys with more than a ``HOT``-th of the rows, of which there are fewer than ``HOT``, are broadcast; the others are dealt out.
    Both sides are read twice, so they are best written tables.
    """
    limit = max(1000, (one.agg(F.sum("n")).first()[0] or 0) // HOT)
    often = rows.join(F.broadcast(one.where(F.col("n") > limit).drop("n")), list(keys))
    return often.unionByName(rows.join(one.where(F.col("n") <= limit).drop("n"), list(keys)))


def _named(marked: DataFrame, distinct: DataFrame, edges: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, words and component_id of each row of ``marked``, from links between the ids of ``distinct`` (id, words,
    first: the smallest doc_id, n: its rows)."""
    found = written(components(edges).withColumnRenamed("node", "id"), "components")
    members = written(found.join(distinct.select("id", "first"), "id"), "members")
    smallest = written(members.groupBy("label").agg(F.min("first").alias("smallest"), F.count("*").alias("n")), "smallest")
    tied = joined(members, smallest, "label").select("id", "smallest")
    named = distinct.join(tied, "id", "left").select(*words, "n", F.coalesce("smallest", "first").alias("component_id"))
    return joined(marked.select("doc_id", *words), written(named, "named"), *words).select("doc_id", *words, "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, group_size: int = 64) -> DataFrame:
    """doc_id, w0 (the fingerprint) and component_id for each row of ``docs``: links are distances of ``distance`` bits or less."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("w0").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.col("w0"))
    distinct = written(distinct, "distinct-fingerprints")
    masks = exact_masks(distinct.count(), distance, group_size)
    edges = linked(distinct.select("id", "w0"), masks, distance, distance)
    return _named(marked, distinct, edges.select("a", "b"), ["w0"])


def sketches(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """Of each row: row (a hash of it), doc_id, and of the set of its text's distinct shingles: w0, w1 (a 128-bit digest), f0, f1
    (a 128-bit SimHash), size and keys: ``bands`` hashes of the least values of ``ROWS`` permutations each; none for an empty set."""

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        random = np.random.default_rng(17)
        mask, factor = (random.integers(0, 1 << 32, bands * ROWS, dtype=np.uint32) for _ in range(2))
        factor |= np.uint32(1)
        step = max(1, (1 << 20) // (bands * ROWS))
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def keys(own):
            """Two sets have a band's key in common with the chance similarity ** ROWS."""
            short, least = (own >> np.uint64(32)).astype(np.uint32), np.full(bands * ROWS, 0xFFFFFFFF, np.uint32)
            for lo in range(0, len(short), step):
                np.minimum(least, ((short[lo : lo + step, None] ^ mask) * factor).min(axis=0), out=least)
            key = salt.copy()
            for k in range(ROWS):
                key = (key ^ least[k::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            return key.view(np.int64)

        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, len(b), 1000)):
            words, found, sizes, lists = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(text, shingle))
                words.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64))
                found.append(simhash_of(own, 2))
                sizes.append(len(own))
                lists.append(keys(own) if len(own) else np.zeros(0, np.int64))
            w, f = np.array(words, np.int64).reshape(-1, 2), np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))
            columns = [pa.array(x.copy()) for x in (w[:, 0], w[:, 1], f[:, 0], f[:, 1])]
            columns += [pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            names = ["row", "doc_id", "w0", "w1", "f0", "f1", "size", "keys"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs).mapInArrow(hashed, f"row long, doc_id {kind}, w0 long, w1 long, f0 long, f1 long, size int, keys array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), doc_id and text."""
    return texts(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id, size and shingles of the sets of ``wanted`` (id, row: of a text that has the set, w0)."""

    def sets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            digests = [int(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)[0]) for x in found]
            took = np.flatnonzero(np.array(digests, np.int64) == batch.column("w0").to_numpy())  # rows of equal hash
            chosen = [found[i].view(np.int64) for i in took]
            ends = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*chosen, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(took)), lists], ["id", "shingles"])

    found = _rows(docs).join(wanted, "row").select("id", "w0", "text").mapInArrow(sets, "id long, shingles array<long>")
    return found.groupBy("id").agg(F.any_value("shingles").alias("shingles"))  # repeated rows


def alike(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b: ids of ``distinct``) whose sets of shingles are at least ``similarity`` alike.

    A set that many others are compared with is sent in copies, one for each ``TOGETHER`` of them.
    """
    pairs = written(pairs.distinct(), "possible-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = distinct.join(ids, "id", "left_semi").select("id", "row", "w0")
    sets = written(sets_of(docs, wanted, shingle), "shingle-sets")
    often = written(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / TOGETHER).cast("int")), "compared")
    dealt = joined(pairs, often, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    copies = often.select(F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    y = sets.join(copies, "id").select(F.col("id").alias("b"), "copy", F.col("shingles").alias("y"))
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    both = dealt.join(x, "a").join(y, ["b", "copy"])
    shared = F.size(F.array_intersect("x", "y"))
    found = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return found.where(F.col("shared") >= similarity * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b")


def _differ(x: str, y: str):
    """How many bits of the fingerprints of x and y differ."""
    return F.bit_count(F.col(f"{x}.f0").bitwiseXOR(F.col(f"{y}.f0"))) + F.bit_count(F.col(f"{x}.f1").bitwiseXOR(F.col(f"{y}.f1")))


def _sizes_allow(similarity: float):
    return F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9


def _groups(batches: Iterator, *by: str) -> Iterator:
    """The rows of each group, one after the other, of sorted batches: tables with equal values of ``by``."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        edges = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            own = tuple(int(c[lo]) for c in columns)
            if own != key and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_chunks(rows: DataFrame, most: int, shingles: int) -> DataFrame:
    """The rows of ``rows`` (key, id, label, size, ...) whose key has several labels, with i and j: once for each pair of chunks of
    its key that its own is in. A chunk has about ``most`` rows or ``shingles`` shingles."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"))
    chunks = F.ceil(F.greatest(F.col("n") / most, F.col("total") / shingles)).cast("int")
    sizes = written(sizes.where("low <> high").select("key", "n", chunks.alias("chunks")), "mixed-keys")
    own = F.pmod(F.xxhash64("label", "id"), F.col("chunks")).cast("int")
    dealt = joined(rows, sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _grouped(rows: DataFrame) -> DataFrame:
    """The rows of each key and pair of chunks one after the other, in one partition."""
    return rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _candidates(group, distance: int, similarity: float, visit) -> None:
    """Calls ``visit`` with pairs of positions in ``group`` of different labels, sizes that allow the similarity and fingerprints near
    each other, block by block, so that a large group's pairs are never held together."""
    import numpy as np

    label, f0, f1, size = (group.column(c).to_numpy() for c in ("label", "f0", "f1", "size"))

    def allowed(a, b) -> None:
        near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        visit(a[near], b[near])

    search_groups(np.stack([f0, f1], axis=1).view(np.uint64), np.zeros(len(label), np.int64), distance, -1, label, allowed)


def _confirmed(group, similarity: float, distance: int):
    """(a, b): ids of ``group`` (one key's rows, with their keys and shingles) that join all that pairs of sets at least
    ``similarity`` alike join: a forest. A pair is compared under the first key it shares, and only if nothing joins it yet."""
    import numpy as np

    ids, key = group.column("id").to_numpy(), group.column("key")[0].as_py()
    keys = group.column("keys").chunk(0).flatten().to_numpy().reshape(len(ids), -1)
    shingles = group.column("shingles").chunk(0)
    size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    local = np.unique(shingles.flatten().to_numpy(), return_inverse=True)[1]
    start = np.cumsum(size) - size
    root, there = np.unique(group.column("label").to_numpy(), return_inverse=True)[1], np.zeros(int(local.max(initial=0)) + 1, bool)
    out: list[tuple[int, int]] = []

    def compare(a, b) -> None:
        for lo in range(0, len(a), PIECE):
            x, y = a[lo : lo + PIECE], b[lo : lo + PIECE]
            same = keys[x] == keys[y]
            first = keys[x, same.argmax(axis=1)] == key
            x, y = x[first], y[first]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            for lo_, hi in zip(*_runs(x), strict=True):
                one, others = x[lo_], y[lo_:hi]
                others = others[root[others] != root[one]]
                if not len(others):
                    continue
                own = local[start[one] : start[one] + size[one]]
                there[own] = True
                n = size[others]
                at = np.repeat(start[others] - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.add.reduceat(there[local[at]], np.cumsum(n) - n, dtype=np.int64)
                there[own] = False
                for other in others[shared >= similarity * (size[one] + n - shared) - 1e-9].tolist():
                    if root[other] != root[one]:
                        root[root == root[other]] = root[one]
                        out.append((one, other))

    _candidates(group, distance, similarity, compare)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def _runs(sorted_values):
    """Where each run of equal values starts and ends."""
    import numpy as np

    edges = (np.flatnonzero(np.diff(sorted_values)) + 1).tolist()
    return ([0, *edges], [*edges, len(sorted_values)]) if len(sorted_values) else ([], [])


def across_labels(docs: DataFrame, distinct: DataFrame, rows: DataFrame, distance: int, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links between ids of ``rows`` (key, id, label, f0, f1, size) that share a key and have different labels, as a
    forest for each key or pair of its chunks. A first search finds the rows with any candidate; their sets are sent to a second,
    which confirms in place, so that pairs that turn out unlike are never listed."""

    def nearby(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for group in _groups(batches, "key", "i", "j"):
            near = np.zeros(len(group), bool)

            def mark(a, b, near=near) -> None:
                near[a] = near[b] = True

            _candidates(group, distance, similarity, mark)
            yield from group.select(["key", "id"]).filter(pa.array(near)).to_batches()

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in _groups(batches, "key", "i", "j"):
            a, b = _confirmed(group, similarity, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    near = written(_grouped(_by_chunks(rows, 4096, 1 << 40)).mapInArrow(nearby, "key long, id long").distinct(), "nearby")
    wanted = distinct.join(near.select("id").distinct(), "id", "left_semi")
    sets = written(sets_of(docs, wanted.select("id", "row", "w0"), shingle).join(wanted.select("id", "keys"), "id"), "shingle-sets")
    chosen = written(rows.join(near, ["key", "id"]), "chosen")
    full = _grouped(_by_chunks(chosen, 1024, 400_000).join(sets, "id"))
    return full.mapInArrow(confirm, "a long, b long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, stars: int = 12) -> DataFrame:
    """doc_id, w0, w1 (the digest of the shingle set) and component_id: documents link if their sets of shingles are at least
    ``similarity`` alike.

    Equal sets are one entry. Candidates share a key of least values (two sets of the similarity sought miss each other
    with a chance of ``MISS``, whatever the number of documents) and have SimHash fingerprints that differ in at most as many
    bits as such sets have but for one in a billion. Every link is checked by the whole sets. Groups are never listed in pairs:
    while keys hold many pairs that no link joins yet, each key compares its members with one of them; the pairs left are found
    by the Gray-order index, which passes over whole nodes that are linked or too far apart, and confirmed where they are found.
    """
    alone = math.acos(2 * similarity / (1 + similarity)) / math.pi  # the chance that a bit differs, for sets of one size
    distance = math.ceil(128 * alone + 6 * math.sqrt(128 * alone * (1 - alone)))
    bands = 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))
    marked = written(sketches(docs, shingle, bands), "sketches")
    words = ["w0", "w1"]
    first = [F.any_value(c).alias(c) for c in ("f0", "f1", "size", "keys")]
    distinct = marked.groupBy(*words).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("row").alias("row"), *first)
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    every = distinct.select(F.explode("keys").alias("key"), "id", "f0", "f1", "size")
    shared = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    others = joined(every.select("key", "id"), shared.withColumn("others", F.col("n")), "key")
    company = written(others.groupBy("id").agg(F.sum("others").alias("company")), "company")
    postings = written(joined(every, shared, "key").join(company, "id"), "postings")
    links, spent = (docs.sparkSession.createDataFrame([], kinds) for kinds in ("a long, b long", "id long"))
    room = 64 * postings.count() + 1000
    rows, before = postings.withColumn("label", F.col("id")), math.inf
    for star in range(stars + 1):
        same = rows.groupBy("key", "label").agg(F.count("*").cast("double").alias("g"))
        across = same.groupBy("key").agg((F.sum("g") * F.sum("g") - F.sum(F.col("g") * F.col("g"))).alias("p"))
        left = across.agg(F.sum("p")).first()[0] or 0.0
        if left == 0:
            break
        last = star > 0 and (left / 2 <= room or left > 0.75 * before) or star == stars
        before = left
        if last:
            links = written(links.unionByName(across_labels(docs, distinct, rows, distance, similarity, shingle)), "similar-pairs")
            break
        # The members with most company under all their keys are likely to be what the others are copies of.
        one = F.max_by(F.struct("id", "f0", "f1", "size", "label"), F.struct("company", F.xxhash64("id", F.lit(star)), "id"))
        fresh = rows.join(spent, "id", "left_anti")
        pivots = written(fresh.groupBy("key").agg(one.alias("y")).join(shared, "key"), "pivots")
        spent = written(spent.unionByName(pivots.select("y.id")).distinct(), "spent-pivots")
        near = joined(rows.select("key", F.struct("id", "f0", "f1", "size", "label").alias("x")), pivots, "key")
        near = near.where((F.col("x.label") != F.col("y.label")) & _sizes_allow(similarity) & (_differ("x", "y") <= distance))
        pairs = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        links = written(links.unionByName(alike(docs, distinct, pairs, similarity, shingle)), "similar-pairs")
        found = components(links).select(F.col("node").alias("id"), F.col("label").alias("joined"))
        rows = postings.join(found, "id", "left").select(*postings.columns, F.coalesce("joined", "id").alias("label"))
        rows = written(rows, "postings")
    return _named(marked, distinct, links, words)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")
