"""Small exact checks of the corpus operators against brute force, with nulls, empty texts, ties and empty tables."""

import zlib

import numpy as np
import pytest
import xxhash

from pitchframe.llm import language, neighbours, packing, queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], DOCS)


def _simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: _simhash(r.text) for r in docs}
    label = {d: d for d in fps}
    moved = True
    while moved:
        moved = False
        for a in sorted(fps):
            near = min(label[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4)
            if near < label[a]:
                label[a], moved = near, True
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op8_simhash"](spark, SF).collect()}
    assert got == {d: (fps[d], label[d]) for d in fps}


def test_simhash_of_odd_rows(spark):
    got = simhash.near_duplicates(_docs(spark, [None, "", "a b", "A B", "a b"])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in queries.QUERIES["op2_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(score - far[ids == v][0]) < 1e-9 for _, v, score in mine)
        hits += len({v for _, v, _ in mine} & set(ids[order]))
    assert hits >= 0.9 * 10 * len(found)


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    got = {r.doc_id: r for r in queries.QUERIES["op3_token_files"](spark, SF).collect()}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing_places_every_id_once(spark):
    rows = queries.QUERIES["op4_packing"](spark, SF).collect()
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in docs.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(_docs(spark, []), __import__("public_tokenizers").path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name, column", [("op7_quality", "score"), ("op10_language", "score")])
def test_scores_are_shares(spark, name, column):
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r[column] <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (5 if name == "op7_quality" else 4) == (0 if name == "op7_quality" else 2)) for r in got)


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op10_language"](spark, sf).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != language.UNDETERMINED]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_fingerprints(spark):
    got = queries.QUERIES["op5_fingerprints"](spark, SF).collect()
    by_text = {}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        assert r.n_chars == len(texts[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])


def test_pseudonyms_keep_rows(spark):
    assert queries.QUERIES["op6_pii"](spark, SF).count() >= 1


def test_modules_of_arrow_are_imported_where_they_are_used():
    """A worker that starts afresh has no pyarrow.compute unless somebody imports it."""
    import pathlib

    for path in pathlib.Path(packing.__file__).parent.parent.rglob("*.py"):
        assert "pa.compute" not in path.read_text(), path
