"""Language ID by multilingual mixture inference.

Each learned language has a distribution over hashed letter trigrams. A document's trigrams are taken as drawn
from a mixture of languages; expectation-maximisation estimates its proportions, and the set of languages is the
one of largest likelihood less ``penalty`` * log(trigrams) for each language beyond the first. The prediction is
the language with the largest share in that set, the score its share.

What is learned is a table of ``BUCKETS`` counts for each language, summed by Spark over all rows given; it is the
same size for any corpus, and more than ``max_languages`` languages are refused.

Defined results: null text, or text without a letter: ``und`` and score 0; rows with a null language teach nothing;
with nothing to learn from, everything is ``und``; equal shares go to the language first in alphabetical order;
text in letters that no learned language has still gets the likeliest of them; repeated rows get equal results; a null doc_id
is not held out (``held_out`` is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BUCKETS = 1 << 15
UNDETERMINED = "und"
SLICE_CHARS = 400_000  #: letters worked on at once by a task, unless one text is longer


@lru_cache(1)
def _letters():
    """For code points below 2**16: the lower-case letter, or a space."""
    import numpy as np

    fold = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            fold[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return fold


def trigrams(texts: list[str]):
    """(hashed trigrams of all texts, how many each text has). A word counts with one space on either side."""
    import numpy as np

    fold, sizes = _letters(), np.array([len(t) + 3 for t in texts], np.int64)
    codes = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = np.flatnonzero(codes >= 1 << 16)
    if len(wide):
        kinds, which = np.unique(codes[wide], return_inverse=True)
        codes = codes.copy()
        codes[wide] = 32
        codes = fold[codes]
        codes[wide] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[which]
    else:
        codes = fold[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = (codes[:-2] != 32) | (codes[1:-1] != 32)
    keep &= owner[:-2] == owner[2:]
    keep &= codes[1:-1] != 32  # centred on a letter
    a, b, c = (codes[i : len(codes) - 2 + i][keep].astype(np.uint32) for i in range(3))
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17)).astype(np.int64), np.bincount(owner[:-2][keep], minlength=len(texts))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    chances: object  #: float32[BUCKETS, languages]


def learn(docs: DataFrame, max_languages: int = 256) -> LanguageModel:
    """The model of all rows of ``docs`` (text, lang)."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if len(sums) > max_languages:
                    raise ValueError(f"more than {max_languages} languages")
                for lo, hi in slices(own):
                    total += np.bincount(trigrams(own[lo:hi])[0], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                ["lang", "bucket", "n"],
            )

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most BUCKETS rows for each of max_languages languages
    names = tuple(sorted(found["lang"].unique()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    weights = np.full((BUCKETS, len(names)), 0.5)
    for i, name in enumerate(names):
        own = found[found["lang"] == name]
        weights[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return LanguageModel(names, (weights / weights.sum(axis=0)).astype(np.float32) if names else weights)


def counted(grams, sizes):
    """(distinct trigrams of each document, how often each occurs, how many distinct ones each document has)."""
    import numpy as np

    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys = np.sort(owner * BUCKETS + grams)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys))).astype(np.float32)
    return keys[first] % BUCKETS, times, np.bincount(keys[first] // BUCKETS, minlength=len(sizes))


def mixtures(chances, grams, sizes, steps: int = 8, penalty: float = 2.0, least: float = 0.02):
    """shares[document, language], 0 outside the chosen set, by expectation-maximisation.

    Arrays over trigrams keep one language a row, so that each step runs along them.
    """
    import numpy as np

    grams, times, kinds = counted(grams, sizes)
    docs, langs = len(sizes), chances.shape[1]
    there = np.flatnonzero(kinds)
    found = np.zeros((docs, langs))
    if not len(there):
        return found
    kinds, total = kinds[there], sizes[there].astype(np.float32)
    # Likelihoods relative to the best language of each trigram: shares depend on ratios alone.
    own = np.ascontiguousarray(chances[grams].T)
    own /= own.max(axis=0)

    def summed(values, counts):
        return np.add.reduceat(values, np.cumsum(counts) - counts, axis=-1)

    def refine(shares, values, weight, counts, n):
        for _ in range(steps):
            joint = values * np.repeat(shares, counts, axis=1)
            joint *= weight / joint.sum(axis=0)
            shares = summed(joint, counts) / n
        return shares

    def likelihood(shares, values, weight, counts):
        return summed(np.log((values * np.repeat(shares, counts, axis=1)).sum(axis=0)) * weight, counts)

    rows = np.arange(len(there))
    single = summed(np.log(own) * times, kinds)
    free = refine(np.full((langs, len(there)), 1 / langs, np.float32), own, times, kinds, total)
    best, chosen = single.max(axis=0), np.zeros((langs, len(there)))
    chosen[single.argmax(axis=0), rows] = 1
    order = np.argsort(-free, axis=0, kind="stable")
    mixed, size = rows, 2
    while size <= langs:
        # The set of the ``size`` largest shares, against the best smaller set so far.
        mixed = mixed[free[order[size - 1, mixed], mixed] >= least]
        if not len(mixed):
            break
        take = np.repeat(np.isin(rows, mixed), kinds)
        values, weight, counts, n = own[:, take], times[take], kinds[mixed], total[mixed]
        start = np.zeros((langs, len(mixed)), np.float32)
        np.put_along_axis(start, order[:size, mixed], 1, axis=0)
        start *= np.maximum(free[:, mixed], 1e-6)
        shares = refine(start / start.sum(axis=0), values, weight, counts, n)
        value = likelihood(shares, values, weight, counts) - penalty * (size - 1) * np.log(n + 1)
        better = value > best[mixed]
        best[mixed[better]], chosen[:, mixed[better]] = value[better], shares[:, better]
        size += 1
    found[there] = chosen.T
    return found


def predict(docs: DataFrame, model: LanguageModel, *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """``keep`` and, under ``names``, the language, its share, and the chosen set (largest share first) for each row of ``docs``."""
    if set(names) & set(keep):
        raise ValueError(f"columns {sorted(set(names) & set(keep))} are there already; give the results other names")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats

    def infer(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known_names, chances = shipped.value.names, shipped.value.chances
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, sets = [], [], []
            for lo, hi in slices(texts):
                grams, sizes = trigrams(texts[lo:hi])
                if not known_names:
                    shares = np.zeros((hi - lo, 0))
                else:
                    shares = mixtures(chances, grams, sizes)
                for row in shares:
                    known = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    langs.append(known_names[known[0]] if known else UNDETERMINED)
                    scores.append(min(1.0, float(row[known[0]])) if known else 0.0)
                    sets.append([known_names[i] for i in known])
            arrays = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], [*keep, *names])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"{kinds}`{names[0]}` string, `{names[1]}` double, `{names[2]}` array<string>"
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(infer, schema)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs, model, "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
