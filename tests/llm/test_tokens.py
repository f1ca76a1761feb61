"""Token files and packing: special tokens, odd rows, damaged files, and first-fit decreasing by brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitchframe.llm import coder, packing, token_files
from pitchframe.llm.shared import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string, start int"  # the last two clash with columns of the results
TEXTS = [
    None, "", " ", "hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b <|EndOfText|>", "two  spaces\r\nand\tmore", "x" * 200,
    "hello <|endoftext|> world", "Übergröße 日本語 😀 \n\n end", " ".join(f"word{i % 977}" for i in range(60_000)),
]


def _ids(path, text, end):
    lib = Tokenizer.from_file(path)
    return np.array([*lib.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def test_files_hold_the_ids_of_the_library(spark):
    path = new_path(spark, "token-files")
    token_files.encode_files(_docs(spark, TEXTS), path, BYTES)
    at, got = 0, {r.doc_id: r for r in token_files.decode_files(spark, path).collect()}
    sums = {r.doc_id: r.ids_crc32 for r in token_files.decode_files(spark, path, checksums=True).collect()}
    for d, text in enumerate(TEXTS):
        want = _ids(BYTES, text, 0)
        assert (got[d].start, got[d].n_tokens, bytes(got[d].ids), sums[d]) == (at, len(want), want.tobytes(), zlib.crc32(want))
        at += len(want)


def test_repeated_ids_nulls_and_empty_tables(spark):
    path = new_path(spark, "token-files")
    rows = [(5, "b", "x", 1), (5, "a", "x", 1), (2, "c", "x", 1), (5, "a", "x", 1)]
    token_files.encode_files(spark.createDataFrame(rows, DOCS), path, BYTES)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_files.decode_files(spark, path).collect())
    want = [_ids(BYTES, t, 0).tobytes() for t in "caab"]
    assert [g[1:] for g in got] == list(zip([2, 5, 5, 5], want, strict=True))
    path = new_path(spark, "token-files")
    token_files.encode_files(_docs(spark, []), path, BYTES)
    assert token_files.decode_files(spark, path).count() == 0
    with pytest.raises(Exception, match="doc_id is null"):
        token_files.encode_files(spark.createDataFrame([(None, "a", "x", 1)], DOCS), new_path(spark, "token-files"), BYTES)


@pytest.mark.parametrize("largest, n", [(3, 5000), (50_256, 9000), ((1 << 30) - 1, 3000), (0, 4096), (255, 1), (7, 0)])
def test_coder_round_trip(largest, n):
    ids = np.random.default_rng(largest + n).integers(0, largest + 1, n).astype("<u4")
    ids[n // 2 : n // 2 + 700] = ids[:700][: len(ids[n // 2 : n // 2 + 700])]  # repeats, which order 2 foresees
    coded = coder.encode_segment(np.array([3, 4]), np.array([n, 0]), ids, 512)
    docs, lengths, back = coder.decode_segment(coded)
    assert (docs.tolist(), lengths.tolist(), back.tobytes()) == ([3, 4], [n, 0], ids.tobytes())


def test_repeats_are_coded_small():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 64), 32).astype("<u4")
    assert len(coder.encode_segment(np.array([1]), np.array([len(ids)]), ids)) < len(ids) // 2


def test_damage_is_found():
    ids = np.arange(6000, dtype="<u4") % 700
    coded = coder.encode_segment(np.array([1]), np.array([len(ids)]), ids)
    for at in (0, 12, coder.HEADER.size + 3, len(coded) // 2, len(coded) - 40):
        hurt = bytearray(coded)
        hurt[at] ^= 0x55
        with pytest.raises(ValueError):
            coder.decode_segment(bytes(hurt))
    with pytest.raises(ValueError):
        coder.decode_segment(coded[:10])


def test_first_fit_decreasing_is_brute_force():
    draw = random.Random(4)
    for n in (0, 1, 2, 7, 60, 300):
        sizes = [draw.choice([1, 5, 50, 99, 100, draw.randrange(1, 101)]) for _ in range(n)]
        room, bins, offsets = [], [0] * n, [0] * n
        for i in sorted(range(n), key=lambda k: -sizes[k]):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            bins[i], offsets[i] = at, 100 - room[at]
            room[at] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == (bins, offsets)


def test_packed_pieces_are_the_ids_of_the_library(spark):
    rows = packing.pack(_docs(spark, TEXTS), WORDS).collect()
    bins: dict = {}
    for d, text in enumerate(TEXTS):
        ids, at = _ids(WORDS, text, 1), 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b", "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), WORDS).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 3), (False, 3), (True, 3)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3
    narrow = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert [r.doc_id for r in packing.pack(narrow, WORDS).collect()] == [1]
    assert packing.pack(_docs(spark, []), WORDS).count() == 0
