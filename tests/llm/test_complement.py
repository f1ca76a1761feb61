"""Best-fit packing by exact complements: plans against brute force, ids against the library, odd rows."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchframe.llm import complement, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KEPT: dict = {}  #: encoders of both vocabularies, made once


def _fewest(sizes, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                place(i + 1, (*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]))
        place(i + 1, (*rooms, capacity - sizes[i]))

    place(0, ())
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7))
def test_plans_hold_every_piece_in_few_sequences(sizes):
    made, packed = complement.plan(Counter(sizes), 12), Counter()
    for parts, n in made:
        assert n > 0 and 0 < sum(parts) <= 12
        for p in parts:
            packed[p] += n
    assert packed == Counter(sizes)
    used = sum(n for _, n in made)
    assert used <= _fewest(sizes, 12) + 1 and used <= -(-3 * _fewest(sizes, 12) // 2)


def test_gaps_are_filled_by_one_two_and_three_lengths():
    for others in ((3,), (2, 1), (1, 1, 1)):
        assert complement.plan(Counter((9, *others)), 12) == [((9, *others), 1)]
    assert complement.plan({9: 5, 3: 2, 2: 1, 1: 4}, 12) == [((9, 3), 2), ((9, 2, 1), 1), ((9, 1, 1, 1), 1), ((9,), 1)]
    assert complement.plan({12: 10**12, 6: 10**12}, 12) == [((12,), 10**12), ((6, 6), 5 * 10**11)]


def test_dense_counts_leave_next_to_no_padding():
    random = np.random.default_rng(3)
    sizes = np.minimum(1024, random.lognormal(5.5, 1, 100_000).astype(int) + 1)
    used = sum(n for _, n in complement.plan(Counter(sizes.tolist()), 1024))
    assert used <= 1.001 * -(-sizes.sum() // 1024)


def _checked(rows, texts, capacity):
    """Every document's ids lie once, gapless, in its pieces, and every sequence is gapless from 0."""
    from tokenizers import Tokenizer

    lib, by_doc, by_sequence = Tokenizer.from_file(VOCABULARY), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        assert all(p.length == capacity for p in pieces[1:])
        for p, at in zip(pieces, itertools.accumulate([0, *(p.length for p in pieces)]), strict=False):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
        assert sum(p.length for p in pieces) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_every_id_lies_in_one_piece(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_complement_packing"](spark, sf).collect()
    assert _checked(rows, texts, 1024) <= 1.1 * -(-sum(r.length for r in rows) // 1024)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a b c", 4: "word " * 50_000, 5: "x" * 30_000, 6: "a b c", None: "no id"}
    docs = spark.createDataFrame([(d, t, "s", 7) for d, t in texts.items()], "doc_id long, text string, sequence_id string, rank int").repartition(3)
    rows = complement.pack(docs, VOCABULARY, capacity=64).collect()
    _checked(rows, texts, 64)
    twice = complement.pack(docs.where("doc_id = 3").union(docs.where("doc_id = 3")), VOCABULARY).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].length}
    assert complement.pack(docs.where("doc_id = 99"), VOCABULARY).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcé9'.,;:!? \n\t\rªµß中Ꮿ·́"), max_size=30), max_size=4))
def test_words_with_signs_behind_them_are_the_librarys(texts):
    from tokenizers import Tokenizer

    from pitchframe.llm.tokens import WordEncoder

    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        if name not in KEPT:
            KEPT[name] = Tokenizer.from_file(path), WordEncoder(path, spaced, max_words=50)
        lib, mine = KEPT[name]
        assert mine.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
