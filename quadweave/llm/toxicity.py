"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.shared import written
from quadweave.llm.words import _BASE, ALNUM_LOWER, Words, chunks, mix, mixed

#: Labelled documents to learn from, at most: those with the least hash of their id; and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 6000, 32 << 20
#: Beginnings of words, in bytes, that count as features beside whole words. A feature must be tied to the label: chance
#: alone must give its split between the labels with less than exp(-EVIDENCE).
PREFIXES, EVIDENCE = (4, 5, 6), 9.0
THRESHOLD = 0.7
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def word_features(found: Words) -> np.ndarray:
    """32-bit hashes, a row per word: the word, and its beginnings (of shorter words, the whole word once more)."""
    out = [found.hashes]
    total, power = np.zeros(len(found.first), np.uint64), 1
    for i in range(max(PREFIXES)):
        at = found.first + i
        inside = at < found.last
        total[inside] += ALNUM_LOWER.value[found.data[at[inside]]] * np.uint64(power)
        power = power * _BASE % (1 << 64)
        if i + 1 in PREFIXES:
            out.append(mix(total + np.uint64(mixed(i))))
    return (np.stack(out, axis=1) >> np.uint64(32)).astype(np.uint32)


def sentence_starts(found: Words) -> np.ndarray:
    """Indexes of the words that begin a sentence: after . ! ? or a line end, or at the start of a text."""
    if not len(found.first):
        return np.zeros(0, np.int64)
    marks = np.cumsum(_ENDS[found.data], dtype=np.int64)[found.first]
    new = np.concatenate([[True], marks[1:] != marks[:-1]])
    new[found.at[:-1][found.counts > 0]] = True
    return np.flatnonzero(new)


@dataclass(frozen=True)
class Model:
    """keys: sorted feature hashes; weight of each; seen: which values of the top 20 bits occur among keys."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float
    seen: np.ndarray

    def logits(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and logit of each sentence."""
        starts = sentence_starts(found)
        if not len(starts):
            return starts, np.zeros(0)
        features = word_features(found)
        total = np.zeros(len(found.first))
        for c in range(features.shape[1]):
            f = features[:, c]
            maybe = np.flatnonzero(self.seen[f >> np.uint32(12)])
            at = np.minimum(np.searchsorted(self.keys, f[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == f[maybe]
            total[maybe[hit]] += self.weight[at[hit]]
        return starts, np.add.reduceat(total, starts) + self.bias


def model(keys: np.ndarray, weight: np.ndarray, bias: float) -> Model:
    keys, weight = (keys, weight) if len(keys) else (np.zeros(1, np.uint32), np.zeros(1))
    seen = np.zeros(1 << 20, bool)
    seen[keys >> np.uint32(12)] = True
    return Model(keys, weight, bias, seen)


def unlike(docs: list[tuple[np.ndarray, np.ndarray, int]], sketch: int = 16) -> list[int]:
    """Indexes of documents that are no near copies of an earlier one: fewer than half of their `sketch` least feature
    hashes are among an earlier document's. Copies would make any of their words look tied to their label."""
    kept, holders = [], {}
    for i, d in enumerate(docs):
        low = np.unique(d[0])[:sketch].tolist()
        met: dict[int, int] = {}
        for x in low:
            for j in holders.get(x, ()):
                met[j] = met.get(j, 0) + 1
        if 2 * max(met.values(), default=0) < max(len(low), 2):
            kept.append(i)
            for x in low:
                holders.setdefault(x, []).append(i)
    return kept


def evidence(n1: np.ndarray, n0: np.ndarray, prior: float) -> np.ndarray:
    """Bound on -log of the chance of a split n1 : n0 or a more extreme one, where a share `prior` of documents has label 1."""
    n = n1 + n0
    q = np.clip(n1 / n, 1e-12, 1 - 1e-12)
    return n * (q * np.log(q / prior) + (1 - q) * np.log((1 - q) / (1 - prior)))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 120, rate: float = 0.08, decay: float = 3e-5) -> Model:
    """docs: (features, features per sentence, label). Minimises the log loss of noisy-or, P = 1 - prod(1 - p_s), where
    p_s is the logistic function of a sentence's summed weights, by gradient steps (Adam) over all documents."""
    docs = [d for d in docs if len(d[1])]
    docs = [docs[i] for i in unlike(docs)]
    y = np.array([d[2] for d in docs], float)
    if not len(docs) or y.min() == y.max():  # nothing to tell apart
        return model(np.zeros(0, np.uint32), np.zeros(0), -8.0 if not len(docs) or not y.max() else 0.0)
    own = [np.unique(d[0]) for d in docs]
    keys, both = np.unique(np.concatenate(own), return_counts=True)
    toxic, n1 = np.unique(np.concatenate([u for u, label in zip(own, y, strict=True) if label > 0]), return_counts=True)
    of_toxic = np.zeros(len(keys), np.int64)
    of_toxic[np.searchsorted(keys, toxic)] = n1
    keys = keys[evidence(of_toxic, both - of_toxic, y.mean()) > EVIDENCE]
    del own, both, of_toxic
    if not len(keys):
        return model(keys, np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    ats, sentences, before = [], [], 0
    for features, sizes, _ in docs:
        at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
        known = np.flatnonzero(keys[at] == features)
        ats.append(at[known].astype(np.int32))
        sentences.append((before + np.searchsorted(np.cumsum(sizes), known, "right")).astype(np.int32))
        before += len(sizes)
    at, sentence = np.concatenate(ats), np.concatenate(sentences)
    n = sum(len(d[1]) for d in docs)
    first = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])[:-1]])
    doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    balance = np.where(y > 0, (0.5 / y.mean()) ** 0.5, 1.0)
    w, m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    w[-1] = -4.0
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[at], n) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.add.reduceat(-np.logaddexp(0, z), first))  # chance that no sentence is toxic
        slope = (balance * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0))[doc] * p / len(docs)
        g = np.append(np.bincount(at, slope[sentence], len(keys)), slope.sum()) + decay * w * np.append(np.ones(len(keys)), 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
    keep = np.abs(w[:-1]) > 0.05
    return model(keys[keep], w[:-1][keep], float(w[-1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, features, features per sentence)"""
    for batch in batches:
        for part, found in chunks(batch.column(1), ALNUM_LOWER):
            f, starts = word_features(found), sentence_starts(found)
            sizes = np.diff(np.append(starts, len(f))) * f.shape[1]
            at = np.searchsorted(starts, found.at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.start, part.stop - part.start),
                pa.array([f[a:b].ravel().view(np.int32) for a, b in zip(found.at, found.at[1:], strict=False)], pa.list_(pa.int32())),
                pa.array([sizes[a:b].astype(np.int32) for a, b in zip(at, at[1:], strict=False)], pa.list_(pa.int32())),
            ], names=["label", "features", "sizes"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int, sample_bytes: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(label, text, ...) of at most `sample` labelled documents, and as many of these as have `sample_bytes` of text together
    or less, in order of the hash of their ids. Of rows that repeat an id the one with the greatest text counts, of labels
    the greatest one. Only the columns named are read, so that others may have any names."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y is not null")
    some = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    named = {f"x{n}": F.col(c) for n, c in enumerate(also)}
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.coalesce(text_col, F.lit("")).alias("text"), *(c.alias(n) for n, c in named.items())).alias("row"))
    rows = rows.join(F.broadcast(some), F.col("id") == F.col("i")).groupBy("i", "y").agg(F.max("row").alias("row"))
    rows = written(rows.select("i", F.col("y").alias("label"), "row.*"), "labelled")  # `sample` rows at most
    before = F.sum("bytes").over(Window.orderBy(F.xxhash64("i"), "i"))  # numbers alone; the texts stay where they are
    taken = rows.select("i", F.octet_length("text").alias("bytes")).withColumn("sum", before).filter(F.col("sum") <= sample_bytes)
    return rows.join(F.broadcast(taken.select("i")), "i").select("label", "text", *named)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from at most `sample` labelled documents, and `sample_bytes` of text, those with the least hash of their id; all
    labels are candidates. Null labels and ids are left out, null texts are empty, and of an id that is repeated one row
    counts. Without labels of both kinds, as in empty tables, every document gets the same low or even score."""
    rows = labelled(docs, labels, label, id_col, text_col, sample, sample_bytes).mapInArrow(_features, "label int, features array<int>, sizes array<int>").toArrow()
    return train([(f.values.to_numpy(zero_copy_only=False).view(np.uint32), s.values.to_numpy(zero_copy_only=False), y.as_py()) for y, f, s in zip(*rows.columns, strict=True)])


def score(docs: DataFrame, fitted: Model, id_col: str = "doc_id", text_col: str = "text", sentence: float = 0.5) -> DataFrame:
    """Scores whole texts: id, score (noisy-or of all sentences, 0 without words) and offending, the sentences with a
    probability of `sentence` or more as byte ranges (first, last) of the text with their probability p.

    Each row is scored alone, whatever its id: null and repeated ids too. Null and empty texts have no words; a long text
    is scored whole, in memory of its own size; equal texts have equal scores; other columns of docs are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in chunks(batch.column(1), ALNUM_LOWER):
                starts, z = sent.value.logits(found)
                at = np.searchsorted(starts, found.at)
                none = np.concatenate([[0], np.cumsum(np.logaddexp(0, z))])
                p = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(p >= sentence)
                ends = np.append(starts[1:], len(found.first)) - 1
                doc = np.searchsorted(at, bad, "right") - 1
                lens = _text_starts(batch.column(1).slice(part.start, part.stop - part.start))
                ranges = pa.StructArray.from_arrays([pa.array(found.first[starts[bad]] - lens[doc], pa.int32()), pa.array(found.last[ends[bad]] - lens[doc], pa.int32()), pa.array(p[bad])], names=["first", "last", "p"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.start, part.stop - part.start),
                    pa.array(-np.expm1(none[at[:-1]] - none[at[1:]])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, at), pa.int32()), ranges),
                ], names=["id", "score", "offending"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, offending array<struct<first:int,last:int,p:double>>")


def _text_starts(texts: pa.Array) -> np.ndarray:
    from quadweave.llm.words import utf8

    return utf8(texts)[1]
