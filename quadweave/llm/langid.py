"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of an n-gram at most; n-grams of a language's profile, and of a document's.
N, PROFILE, DOCUMENT = 3, 400, 400
UNKNOWN = "und"
#: Characters handled at once.
_CHUNK = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Code points of the lower-cased texts, in runs of about _CHUNK characters, each with the index of its first text."""
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        points = np.frombuffer((t.as_py() or "").lower().encode("utf-32-le", "replace"), np.uint32)
        if run and size + len(points) > _CHUNK:
            yield start, run
            run, size, start = [], 0, i
        run.append(points)
        size += len(points)
    if run:
        yield start, run


def ngrams(run: list[np.ndarray], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all runs of 1 to n characters that lie within a word and the blanks around it, by text and
    n-gram; the blank stands for anything but letters. A blank alone is none. 21 bits a character make the key exact."""
    points = np.concatenate([np.concatenate([[32], p, [32]]) for p in run]).astype(np.int64)
    doc = np.repeat(np.arange(len(run)), [len(p) + 2 for p in run])
    letter = _letters()[points]
    points = np.where(letter, points, 0)
    starts = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = letter | starts | np.concatenate([[True], letter[:-1]])  # a blank before the first word, and one after each
    points, doc, letter = points[keep], doc[keep], letter[keep]
    # Characters by their rank among those that occur make keys small enough to be sorted together with the text's number.
    own = np.flatnonzero(np.bincount(points, minlength=1))
    base = len(own) + 1
    if len(run) > 1 and len(run) * base**n >= 1 << 62:  # a great many kinds of characters: half of the texts at a time
        half = len(run) // 2
        (d1, *a), (d2, *b) = ngrams(run[:half], n), ngrams(run[half:], n)
        return np.concatenate([d1, d2 + half]), *(np.concatenate(x) for x in zip(a, b, strict=True))
    digit = np.searchsorted(own, points) + 1
    found, key = [], np.zeros(len(points), np.int64)
    for k in range(1, n + 1):
        m = len(points) - k + 1
        if m <= 0:
            break
        key = key[:m] * base + digit[k - 1 :][:m]
        good = doc[:m] == doc[k - 1 :][:m]
        some = letter[:m].copy()
        for j in range(1, k):
            some |= letter[j : j + m]
        for j in range(1, k - 1):  # a blank in the middle would join two words
            good &= letter[j : j + m]
        good &= some
        found.append(doc[:m][good] * base**n + key[good])
    all_ = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))[: len(all_)]
    doc, small = np.divmod(all_[first], base**n)
    exact = np.zeros(len(small), np.int64)
    for j in range(n):
        small, d = np.divmod(small, base)
        exact |= np.where(d > 0, own[d - 1] + 1, 0) << 21 * j
    return doc, exact, np.diff(np.append(first, len(all_)))


#: Ties of counts are broken by this order of n-grams, which favours no alphabet, and then by the n-grams themselves.
TIES, _STEP = 1_000_003, 7919


def tie(keys):
    return keys % TIES * _STEP % TIES


def count_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n) summed over each run of texts"""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = sorted(set(langs))
        index = {x: i for i, x in enumerate(names)}
        for start, run in _runs(batch.column(1)):
            doc, keys, counts = ngrams(run, n)
            lang = np.array([index[x] for x in langs[start : start + len(run)]])[doc]
            for i in np.unique(lang):
                grams, at = np.unique(keys[lang == i], return_inverse=True)
                sums = np.bincount(at, counts[lang == i], len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(grams)), pa.array(grams), pa.array(sums)], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Profiles:
    """langs in code point order; grams sorted; rank[i, l]: place of gram i in the profile of language l, or its size."""

    langs: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int
    n: int


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = N, size: int = PROFILE) -> Profiles:
    """Each language's `size` most frequent n-grams over all documents with that language. Counts are combined per task
    before the shuffle. The driver gets `size` rows a language."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(lambda it: count_batches(it, n), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), tie(F.col("gram")), "gram")
    ranked = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)  # a limit a group, before the shuffle too
    rows = ranked.select("lang", "gram", F.col("place") - 1).collect()
    langs = sorted({r[0] for r in rows})
    grams = np.array(sorted({r[1] for r in rows}), np.int64)
    rank = np.full((len(grams), max(len(langs), 1)), size, np.int32)
    for lang, gram, r in rows:
        rank[np.searchsorted(grams, gram), langs.index(lang)] = r
    return Profiles(langs, grams, rank, size, n)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", top: int = DOCUMENT) -> DataFrame:
    """The language whose profile is nearest to each whole text by out-of-place distance: over the text's `top` most
    frequent n-grams, the sum of the differences between ranks, with the profile's size for those it lacks.

    Returns id, lang_pred and score: by how much the nearest profile beats the next one, 0 to 1. `und`, with score 0, if
    the text is null or has no letter, or nothing was learned, as from an empty table. Ties go to the first language by code
    point. Each row is looked at alone and whole, whatever its length and id, null and repeated ids too; other columns of
    docs are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for start, texts in _runs(batch.column(1)):
                m = len(texts)
                doc, keys, counts = ngrams(texts, p.n)
                most = int(counts.max(initial=0))
                order = np.argsort((doc * (most + 1) + most - counts) * TIES + tie(keys), kind="stable")  # sorted by keys already
                doc, keys = doc[order], keys[order]
                at = np.searchsorted(doc, np.arange(m + 1))
                rank = np.arange(len(doc)) - at[doc]
                high = rank < top
                doc, keys, rank = doc[high], keys[high], rank[high]
                distance = np.zeros((m, p.rank.shape[1]))
                if len(p.grams) and len(keys):
                    place = np.minimum(np.searchsorted(p.grams, keys), len(p.grams) - 1)
                    theirs = np.where((p.grams[place] == keys)[:, None], p.rank[place], p.size)
                    off = np.where(theirs == p.size, p.size, np.abs(theirs - rank[:, None]))
                    for c in range(off.shape[1]):
                        distance[:, c] = np.bincount(doc, off[:, c], m)
                best = distance.argmin(axis=1)
                least = distance.min(axis=1)
                second = np.partition(distance, 1, axis=1)[:, 1] if distance.shape[1] > 1 else np.full(m, 1.0)
                score = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0.0)
                none = (np.bincount(doc, minlength=m) == 0) | (not p.langs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, m),
                    pa.array([UNKNOWN if x else p.langs[b] for x, b in zip(none, best, strict=True)]),
                    pa.array(np.where(none, 0.0, np.clip(score, 0, 1))),
                ], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
