"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.toxicity import labelled
from quadweave.llm.words import SPACED, Words, chunks

#: Labelled documents to learn from, and bytes of their texts, at most; slots of hashed words; rank of the interactions.
SAMPLE, SAMPLE_BYTES, WORD_SLOTS, RANK = 4000, 32 << 20, 1 << 16, 8
THRESHOLD = 0.5


def _class(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)])


_UPPER, _LETTER = _class(str.isupper), _class(str.isalpha) | (np.arange(256) >= 128)
_DIGIT, _LINE = _class(str.isdigit), np.arange(256) == 10
_MARK = _class(lambda c: 32 < ord(c) < 127 and not c.isalnum())
_ODD_MARK = _class(lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-?()")
STATISTICS = ("upper", "letter", "digit", "mark", "odd_mark", "lines", "repeated_lines", "word_length", "distinct_words", "same_as_before", "odd_word_ends", "long_words", "words", "n_chars")


def statistics(found: Words, offsets: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """One row per text of STATISTICS; the last is metadata, the others come from the text."""
    # same_as_before: words equal to the next one
    size = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[found.data])])
        return np.diff(c[offsets]) / size

    n = np.maximum(found.counts, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values)])[found.at]) / n

    length = (found.last - found.first).astype(float)
    ends = _ODD_MARK[found.data[found.last - 1]] if len(found.last) else np.zeros(0)
    distinct = np.array([len(np.unique(found.hashes[a:b])) for a, b in zip(found.at, found.at[1:], strict=False)])
    same = np.append(found.hashes[1:] == found.hashes[:-1], False)[: len(found.hashes)]
    raw = found.data.tobytes()
    repeated = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        lines = raw[a:b].split(b"\n")
        repeated.append(1 - len(set(lines)) / len(lines))
    return np.stack([share(_UPPER), share(_LETTER), share(_DIGIT), share(_MARK), share(_ODD_MARK), share(_LINE) * 20, np.array(repeated), per_word(length), distinct / n, per_word(same), per_word(ends), per_word(length > 20), np.log1p(found.counts), np.log1p(n_chars)], axis=1)


def _slots(found: Words) -> np.ndarray:
    return (found.hashes >> np.uint64(48)).astype(np.int32)


def _offsets(texts: pa.Array) -> np.ndarray:
    from quadweave.llm.words import utf8

    return utf8(texts)[1]


def _per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Batches whose columns 0 to 2 are (key, text, n_chars) -> the same rows in runs, their words and statistics."""
    for batch in batches:
        for part, found in chunks(batch.column(1), SPACED):
            rows = batch.slice(part.start, part.stop - part.start)
            chars = np.nan_to_num(rows.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False))
            yield rows, found, statistics(found, _offsets(rows.column(1)), np.maximum(chars, 0))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, found, stats in _per_text(batches):
        slots = _slots(found)
        yield pa.RecordBatch.from_arrays([
            rows.column(0),
            pa.array([slots[a:b] for a, b in zip(found.at, found.at[1:], strict=False)], pa.list_(pa.int32())),
            pa.array(list(stats), pa.list_(pa.float64())),
        ], names=["label", "slots", "stats"])


@dataclass(frozen=True)
class Machine:
    """y = bias + sum(w x) + 0.5 * sum_f((sum(v_f x))**2 - sum(v_f**2 x**2)); statistics are centred, scaled and clipped."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def stats(self, s: np.ndarray) -> np.ndarray:
        return np.clip((s - self.mean) / self.scale, -4, 4)

    def logits(self, found: Words, s: np.ndarray) -> np.ndarray:
        """In linear time: each word adds once to the sums and the sums of squares."""
        z, n = self.stats(s), found.counts
        slots, x = _slots(found), 1 / np.sqrt(np.maximum(n, 1))
        k = WORD_SLOTS

        def add(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=float)])[found.at], axis=0)

        v = self.v[slots]
        # A word that occurs c times is one feature of value c * x; squares are taken of distinct words.
        doc = np.repeat(np.arange(len(n)), n)
        key, count = np.unique(doc.astype(np.int64) * k + slots, return_counts=True)
        where = np.searchsorted(key // k, np.arange(len(n) + 1))
        squares = np.concatenate([[0.0], np.cumsum((self.v[key % k].astype(float) ** 2).sum(axis=1) * (count * x[key // k]) ** 2)])
        sums = add(v) * x[:, None] + z @ self.v[k:]
        square = np.diff(squares[where]) + (z * z) @ (self.v[k:].astype(float) ** 2).sum(axis=1)
        linear = add(self.w[slots][:, None])[:, 0] * x + z @ self.w[k:]
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - square)


def train(slots: list[np.ndarray], stats: np.ndarray, y: np.ndarray, steps: int = 40, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Minimises the log loss, classes weighted alike, by gradient steps (Adam) over all documents."""
    k = WORD_SLOTS
    columns = k + len(STATISTICS)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(columns), rng.normal(0, 0.02, (columns, RANK)), 0.0
    if not len(y) or y.min() == y.max():
        return Machine(0.0 if not len(y) else (4.0 if y.max() else -4.0), w.astype(np.float32), (0 * v).astype(np.float32), np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    z = np.clip((stats - mean) / scale, -4, 4)
    row, col, val = [], [], []
    for d, s in enumerate(slots):
        u, c = np.unique(s, return_counts=True)
        row += [np.full(len(u) + z.shape[1], d)]
        col += [u, k + np.arange(z.shape[1])]
        val += [c / np.sqrt(max(len(s), 1)), z[d]]
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    order = np.argsort(col, kind="stable")
    used, at = np.unique(col[order], return_index=True)
    by_row = np.searchsorted(row, np.arange(len(y)))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    moments = [np.zeros_like(x) for x in (w, v, np.zeros(1)) for _ in range(2)]
    for t in range(1, steps + 1):
        vx = v[col] * val[:, None]
        sums = np.add.reduceat(vx, by_row, axis=0)
        score = bias + np.add.reduceat(w[col] * val, by_row) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), by_row))
        g = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        gx = (g[row] * val)[order]
        gw, gv = decay * w, decay * v
        gw[used] += np.add.reduceat(gx, at)
        gv[used] += np.add.reduceat(gx[:, None] * (sums[row] - vx)[order], at, axis=0)
        for i, (x, d) in enumerate(((w, gw), (v, gv), (None, np.array([g.sum()])))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m *= 0.9
            m += 0.1 * d
            s *= 0.99
            s += 0.01 * d * d
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-4)
            if x is None:
                bias -= float(step[0])
            else:
                x -= step
    return Machine(bias, w.astype(np.float32), v.astype(np.float32), mean, scale)


def _meta(docs: DataFrame, text_col: str, chars_col: str | None) -> F.Column:
    return F.col(chars_col).cast("double") if chars_col and chars_col in docs.columns else F.length(text_col).cast("double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", chars_col: str | None = "n_chars", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Learns from at most `sample` labelled documents, and `sample_bytes` of text, those with the least hash of their id; of
    an id that is repeated one row counts, null ids and labels are left out, null texts are empty. Without labels of both
    kinds, as in empty tables, all documents get one score."""
    from_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _meta(docs, text_col, chars_col).alias("chars"))
    from_labels = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    rows = labelled(from_, from_labels, "label", "id", "text", sample, sample_bytes, ("chars",)).mapInArrow(_features, "label int, slots array<int>, stats array<double>").toArrow()
    y = np.array(rows.column(0).to_pylist(), float)
    stats = np.array(rows.column(2).to_pylist(), float).reshape(len(y), len(STATISTICS))
    return train([s.values.to_numpy(zero_copy_only=False) for s in rows.column(1)], stats, y)


def score(docs: DataFrame, fitted: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Scores whole texts: id and score, 0 to 1; null and empty texts are scored by their statistics, all zero. A missing
    or null n_chars counts as 0; without that column the text's length stands for it. Each row is scored alone, whatever
    its id; equal rows get equal scores; long texts are scored whole; other columns of docs are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, stats in _per_text(batches):
            z = np.clip(sent.value.logits(found, stats), -30, 30)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _meta(docs, text_col, chars_col).alias("chars")).mapInArrow(run, "id long, score double")
