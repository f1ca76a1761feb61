"""Encoding texts with the ``tokenizers`` library inside Spark tasks.

A vocabulary's encoder works word by word, and most words of a corpus repeat. ``WordEncoder``
therefore splits a text where the vocabulary's own pre-tokeniser always splits, encodes each new
chunk with the library and keeps its ids; a text's ids are the joined ids of its chunks.
The cache holds about ``max_words`` chunks of at most ``MAX_CHUNK`` characters in two halves; when one is full, the other is
emptied, and what was met since stays, so a worker's memory is bounded whatever the corpus.
"""

from __future__ import annotations

import os
import re

MAX_CHUNK = 64
TOGETHER = 250  #: chunks encoded as one text
TEXTS, CHARACTERS = 10_000, 2_000_000  #: texts split at once, at most (a longer one alone)
WORD_END = "</w>"
ENDS = ".,;:!?"  #: signs that may end a word's chunk
_SPACE, _DOUBLE_SPACE = re.compile(r"\s"), re.compile(r"\s\s")
_LAST: dict[tuple, "WordEncoder"] = {}


def _latin(text: str) -> bool:
    """Whether all characters are below 256, where every library agrees on lower case and normal forms."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """ids of whole texts as little-endian uint32 bytes, equal to the library's own encoding.

    ``spaced``: the vocabulary joins a single space to the word after it (byte-level BPE). Texts
    with runs of white space then go to the library whole, as splitting them could change ids;
    so do texts that hold a special token's string, which the library reads as that token.
    Otherwise the vocabulary is one of lower case, white space only separates words, and a word's ids end with its word end.
    """

    def __init__(self, path: str, spaced: bool, max_words: int = 400_000, characters: int = CHARACTERS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced, self.max_words, self.characters = spaced, max_words, characters
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the chunks kept before these; those met again are kept on
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.id_bytes, self.ends_word = np.zeros(max(vocab.values()) + 1, np.int64), np.full(max(vocab.values()) + 1, spaced)
        for token, i in vocab.items():  # a character for each byte, and the word end
            if not spaced and token.endswith(WORD_END):
                self.ends_word[i], token = True, token[: -len(WORD_END)]
            self.id_bytes[i] = len(token)
        # Signs that the vocabulary's pre-tokeniser parts from the word in front, whose ids are their own.
        self.ends = {c: np.array(self._ids([c])[0], "<u4").tobytes() for c in ENDS if len(self.library.pre_tokenizer.pre_tokenize_str(f"ab{c}")) == 2}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _prepared(self, text: str) -> str | None:
        """The text with a space in front of each of its chunks but the first, whose keys lie between; None if it must be encoded whole."""
        if any(token in text for token in self.special):
            return None
        if not self.spaced:
            return (text.lower() if _latin(text) else text).replace("\n", " ")
        # "\r" marks the start of the text in a key.
        if "\r" in text or _DOUBLE_SPACE.search(text):
            return None
        return "\r" + text.replace("\n", " \n")

    def _chunk_text(self, key: str) -> str:
        if not self.spaced or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\r" else " " + key

    def _cut(self, text: str, n: int, ids: list[int]) -> list[bytes]:
        """The ids of each of the ``n`` chunks joined to ``text``; none at all unless each chunk ends where an id does that can end it."""
        import numpy as np

        found, raw = np.array(ids, dtype="<u4"), np.frombuffer(text.encode(), np.uint8)
        if self.spaced:  # a chunk begins with its space or line end
            ends = np.append(np.flatnonzero((raw == 32) | (raw == 10))[1:], len(raw))
        else:
            between = np.flatnonzero(raw == 32)
            ends = np.append(between, len(raw)) - np.arange(len(between) + 1)
        reached = np.cumsum(self.id_bytes[found])
        last = np.searchsorted(reached, ends)
        if not len(found) or len(ends) != n or reached[-1] != ends[-1] or (reached[last] != ends).any() or not self.ends_word[found[last]].all():
            return []
        raw, cuts = found.tobytes(), (4 * (last + 1)).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def _encode_new(self, keys: list[str]) -> dict[str, bytes]:
        """ids by chunk; words with a sign behind them by the word, whose ids are in front of the sign's."""
        ends, stems, words = self.ends, {}, []
        for k in keys:
            if k[-1:] in ends and (w := k[:-1]).isalpha() and _latin(w):
                stems[k] = w
            else:
                words.append(k)
        found = {w: self.kept.get(w) or self.before.get(w) for w in stems.values()}
        found.update(self._encode_words(list({*words, *(w for w, ids in found.items() if ids is None)})))
        for k, w in stems.items():
            found[k] = found[w] + ends[k[-1]]
        return found

    def _encode_words(self, keys: list[str]) -> dict[str, bytes]:
        """ids by chunk. Most chunks are encoded joined, as they stand in texts, and cut apart again by their bytes."""
        import numpy as np

        if self.spaced:
            together = [k for k in keys if k[:1] != "\r" and not k.isspace() and k]
        else:  # in lower case, as keys of such texts are, and without white space, which the vocabulary drops
            together = [k for k in keys if k and _latin(k) and k == k.lower() and not _SPACE.search(k)]
        found: dict[str, bytes] = {}
        groups = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        texts = [(" " + " ".join(g)).replace(" \n", "\n") if self.spaced else " ".join(g) for g in groups]
        for group, text, ids in zip(groups, texts, self._ids(texts), strict=True):
            found.update(zip(group, self._cut(text, len(group), ids), strict=False))
        alone = [k for k in keys if k not in found]
        for k, ids in zip(alone, self._ids([self._chunk_text(k) for k in alone]), strict=True):
            found[k] = np.array(ids, dtype="<u4").tobytes()
        return found

    def _kept(self, words: list[str]) -> list[bytes]:
        """ids of the chunks, which are all different; new ones are encoded."""
        rows = list(map(self.kept.get, words))
        new = [w for w, ids in zip(words, rows, strict=True) if ids is None]
        if not new:
            return rows
        found = dict(zip(new, map(self.before.get, new), strict=True)) if self.before else dict.fromkeys(new)
        found.update(self._encode_new([w for w, ids in found.items() if ids is None]))
        rows = [found[w] if ids is None else ids for w, ids in zip(words, rows, strict=True)]
        for w in [w for w in found if len(w) > MAX_CHUNK]:
            del found[w]
        if len(self.kept) + len(found) > self.max_words // 2:
            self.kept, self.before = found, self.kept
        else:
            self.kept.update(found)
        return rows

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = []
        sizes, lo = list(map(len, texts)), 0
        while lo < len(texts):
            hi, size = lo + 1, sizes[lo]
            while hi < len(texts) and hi - lo < TEXTS and size + sizes[hi] <= self.characters:
                size, hi = size + sizes[hi], hi + 1
            part = [self._prepared(t) for t in texts[lo:hi]]
            split = pc.split_pattern(pa.array([p for p in part if p is not None], pa.large_string()), " ")
            # Each different chunk is looked up once; a text's ids then stand one behind the other.
            coded = split.flatten().dictionary_encode()
            ids = pa.array(self._kept(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False))])
            cuts = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])].tolist()
            raw = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(ids) else b""
            rows = iter([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
            whole = [t for t, p in zip(texts[lo:hi], part, strict=True) if p is None]
            rest = iter([np.array(x, dtype="<u4").tobytes() for x in self._ids(whole)] if whole else [])
            out += [next(rest) if p is None else next(rows) for p in part]
            lo = hi
        return out


def encoder(path: str, spaced: bool, max_words: int = 400_000, characters: int = CHARACTERS) -> WordEncoder:
    """The worker's encoder of this vocabulary: a reused Python worker keeps its cache between tasks."""
    key = (path, spaced, max_words, characters)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = WordEncoder(*key)
    return _LAST[key]
