"""Language-model scoring by Katz backoff with Good-Turing discounts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.shared import bucketed, forget, sweep, written
from quadweave.llm.words import SPACED_LOWER, Words, chunks, mix, mixed

#: Frequent words, at most, whose counts and context weights are sent to all tasks; those of others are looked up in the
#: tables' partitions, so that the model does not depend on it. Counts above DISCOUNTED are reliable.
VOCABULARY, DISCOUNTED = 65_000, 5
#: Common bigrams, at most, whose counts are sent to all tasks; others are looked up in the table's partitions.
COMMON = 65_000
#: Steps of a doubling of counts: frequent words and common bigrams are those above a step, found from numbers per step.
STEPS = 8
#: Tokens that one partition of the bigram table stands for; bytes of text handled at once.
PARTITION_TOKENS, RUN_BYTES = 1_500_000, 4 << 20
START, END, FIRST = 0, 1, 2
END_HASH = np.uint64(mixed(0xE0D))


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..DISCOUNTED, from n[r], the number of items that occur r times (n has DISCOUNTED + 2 entries): Katz's
    form of Good-Turing, (r*/r - t) / (1 - t) with r* = (r + 1) n[r + 1] / n[r] and t = (k + 1) n[k + 1] / n[1]. Where the
    counts of counts give no discount between 0 and 1, as in tiny or repetitive corpora, (r - 0.5) / r stands in."""
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 1)
    t = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - t) / (1 - t) if n[r] and t < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def least_count(numbers: dict[int, int], most: int) -> int:
    """The lowest step such that no more than `most` items lie in it and above; numbers: items by step. The driver so picks
    the most frequent of any number of items from a few hundred numbers."""
    low = max(numbers, default=0) + 1
    for step in sorted(numbers, reverse=True):
        most -= numbers[step]
        if most < 0:
            break
        low = step
    return low


def steps(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * STEPS).astype(np.int64)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], 1.0)


@dataclass
class Model:
    """What every task needs, of fixed size: counts and context weights of the frequent words, and the common bigrams. Words
    are named by codes: a frequent one by its id, any other by its hash with the top bit set, which reads as negative.
    hashes is sorted; id_of gives the frequent words' ids. total, types: tokens and distinct tokens of the training text.
    p1[w]: discounted unigram probability of id w. unknown: of an unseen word. seen[v], back[v]: factor of discounted bigram
    counts after context v, and its backoff weight."""

    hashes: np.ndarray
    id_of: np.ndarray
    counts: np.ndarray
    total: int
    types: int
    d1: np.ndarray
    d2: np.ndarray
    p1: np.ndarray
    shrink: float
    unknown: float
    seen: np.ndarray
    back: np.ndarray
    common: np.ndarray
    common_counts: np.ndarray

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of word hashes, and their training counts where the words are frequent (0 elsewhere)."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        frequent = self.hashes[at] == h
        return np.where(frequent, self.id_of[at], rare(h)), np.where(frequent, self.counts[at], 0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def word(self, c: np.ndarray) -> np.ndarray:
        """log10 of the unigram probability of a word that occurs c times, 0 for an unknown one."""
        known = discounted(np.maximum(c, 1), self.d1) * self.shrink / max(self.total, 1)
        return np.log10(np.where(c > 0, known, self.unknown))

    def words(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the unigram probabilities of codes w; c holds the counts of those that are not frequent."""
        return np.where(w < 0, self.word(c), np.log10(self.p1[np.maximum(w, 0)]))


def weights(n: np.ndarray, kept: np.ndarray, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of discounted counts and backoff weight of contexts that occur n times, from the sums of their discounted
    counts and of the unigram probabilities of the words seen after them."""
    left = np.maximum(1 - kept / n, 1 / (n + 1))
    return (1 - left) / kept, left / np.maximum(1 - unigram, 1e-9)


def rare(h: np.ndarray) -> np.ndarray:
    return (h | np.uint64(1 << 63)).view(np.int64)


def with_ends(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and where each text starts."""
    at = found.at + np.arange(len(found.at))
    out = np.full(at[-1], END_HASH, np.uint64)
    out[np.arange(len(found.hashes)) + np.repeat(np.arange(len(found.counts)), found.counts)] = found.hashes
    return out, at


def contexts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code before each token; the first of a text follows START."""
    before = np.concatenate([[START], codes[:-1]])
    before[at[:-1]] = START
    return before


def pair_ids(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and for each bigram one number, (place of v) * (distinct codes) + (place of w)."""
    u, at = np.unique(np.concatenate([v, w]), return_inverse=True)
    return u, at[: len(v)] * len(u) + at[len(v) :]


def _home(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The partition of bigrams: all of a rare context lie together; those of a frequent one are spread."""
    return _part(np.where(v < 0, v, v << 32 ^ w), parts)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(77)) % np.uint64(parts)).astype(np.int32)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """64-bit keys and columns beside them, 64-bit ones (int64) or counts (uint32); differences of the keys and compression
    keep it small."""
    # Bytes of equal weight lie together, so that the many zeros compress.
    planes = lambda c: np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()
    keys = np.ascontiguousarray(keys).view(np.int64)
    columns = [np.diff(keys, prepend=np.int64(0)) if len(keys) else keys, *(np.ascontiguousarray(c) for c in columns)]
    head = np.array([x for c in columns for x in (len(c), c.itemsize)], np.int64).tobytes()
    return len(columns).to_bytes(1, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, columns)))


def unpack(block: bytes) -> list[np.ndarray]:
    k = block[0]
    head = np.frombuffer(block[1 : 1 + 16 * k], np.int64).reshape(k, 2).tolist()
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[1 + 16 * k :]) if any(n for n, _ in head) else b"", np.uint8)
    out, at = [], 0
    for n, size in head:
        column = np.ascontiguousarray(data[at : at + size * n].reshape(size, n).T).ravel()
        out.append(column.view(np.int64) if size == 8 else column.view(np.uint32).astype(np.int64))
        at += size * n
    out[0] = np.cumsum(out[0])
    return out


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, found in chunks(batch.column(0), SPACED_LOWER, RUN_BYTES):
            h, n = np.unique(with_ends(found)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])


def _bigram_blocks(model, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in chunks(batch.column(0), SPACED_LOWER, RUN_BYTES):
                h, at = with_ends(found)
                codes, _ = model.value.codes(h)
                u, pair = pair_ids(contexts(codes, at), codes)
                pair, n = np.unique(pair, return_counts=True)
                v, w = u[pair // len(u)], u[pair % len(u)]
                part = _home(v, w, parts)
                order = np.lexsort((v, w < 0, part))  # frequent words first: their codes compress
                v, w, n = v[order], w[order], n[order].astype(np.uint32)
                edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                some = [p for p in range(parts) if edges[p] < edges[p + 1]]
                blocks = [pack(*(c[edges[p] : edges[p + 1]] for c in (v, n, w))) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return run


def _sum_blocks(table: pa.Table) -> pa.Table:
    """Blocks of one partition -> its table: sorted bigrams with counts, how many occur 1..DISCOUNTED + 1 times, and how many
    of frequent words lie in each step."""
    v, n, w = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in table.column("block")), strict=True))
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    n = np.add.reduceat(n[order], first)
    few = np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
    v, w = v[first], w[first]
    by_step = np.bincount(steps(n[(v >= 0) & (w >= 0)]))
    return pa.table({"part": table.column("part").slice(0, 1), "block": pa.array([pack(v, n.astype(np.uint32), w)], pa.binary()), **{k: pa.array([x.tolist()], pa.list_(pa.int64())) for k, x in (("few", few), ("by_step", by_step))}})


def _rare_words(w: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct rare words of a bigram table by the partition that knows their counts."""
    u = np.unique(w[w < 0])
    part = _part(u, parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, u[order[edges[p] : edges[p + 1]]]


def _ask_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, block in zip(batch.column(0), batch.column(1), strict=True):
                asked = list(_rare_words(unpack(block.as_py())[2], parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in asked], pa.int32()), pa.array([home.as_py()] * len(asked), pa.int32()), pa.array([pack(u) for _, u in asked], pa.binary()),
                ], names=["part", "home", "block"])

    return run


def _blocks(table: pa.Table) -> list[bytes]:
    return [b.as_py() for b in table.column("block")] if "block" in table.column_names and table.num_rows else []


def _tell_counts(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Blocks of rare words -> their counts, in the same order. All of them occur in the training text."""
    tables = [unpack(b) for b in _blocks(known)]
    rows = list(zip(*(asked.column(c).to_pylist() for c in ("home", "part", "block")), strict=True)) if asked.num_rows else []
    if rows:
        keys, n = (np.concatenate([t[i] for t in tables]) for i in (0, 1))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    told = [pack(np.zeros(0, np.int64), n[np.searchsorted(keys, unpack(b)[0])].astype(np.uint32)) for _, _, b in rows]
    return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array(told, pa.binary())})


def _with_counts(parts: int):
    def run(told: pa.Table, table: pa.Table) -> pa.Table:
        """A bigram table with the counts of its rare words beside them (0 beside frequent ones)."""
        counts = dict(zip(told.column("part").to_pylist(), _blocks(told), strict=True)) if told.num_rows else {}
        out = []
        for block in _blocks(table):
            v, n, w = unpack(block)
            asked = [(u, unpack(counts[p])[1]) for p, u in _rare_words(w, parts)]
            c = np.zeros(len(w), np.int64)
            if asked:
                words, known = (np.concatenate(x) for x in zip(*asked, strict=True))
                order = np.argsort(words)
                c[w < 0] = known[order][np.searchsorted(words[order], w[w < 0])]
            out.append(pack(v, n.astype(np.uint32), w, c.astype(np.uint32)))
        return pa.table({"part": table.column("part") if out else pa.array([], pa.int32()), "block": pa.array(out, pa.binary())})

    return run


def _context_sums(m: Model, v: np.ndarray, n: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted bigrams: where each context starts, its count, the sum of discounted counts, and of the seen words'
    unigrams; and log10 of each bigram's unigram."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))[: len(v)]
    p = m.words(w, c)
    return first, *((np.add.reduceat(x, first) if len(v) else np.zeros(0)) for x in (n, discounted(n, m.d2), 10**p)), p


def _contexts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigram tables -> the sums of their frequent contexts, which are spread over partitions."""
        for batch in batches:
            for block in batch.column(0):
                columns = unpack(block.as_py())
                columns = [c[columns[0] >= 0] for c in columns]
                first, *sums, _ = _context_sums(model.value, *columns)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0][first]), *(pa.array(x.astype(float)) for x in sums)], names=["v", "n", "kept", "unigram"])

    return run


def _common(low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                v, n, w, _ = unpack(block.as_py())
                high = (v >= 0) & (w >= 0) & (steps(n) >= low)
                yield pa.RecordBatch.from_arrays([pa.array(v[high] << 32 | w[high]), pa.array(n[high])], names=["key", "n"])

    return run


#: What is known of a run of texts: own sums (a row a run), or a block of bigrams to look up.
ASKED = "run long, part int, block binary, own binary"


def _score_runs(model, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> for each run of texts a row with what the model alone tells of each, and blocks of bigrams to look
        up: all that follow a rare word, and those after frequent words that are not common. A block holds distinct bigrams,
        how often each occurs, and the texts it occurs in. A run's number comes from its place in the input, so that a task
        that is repeated gives it again."""
        m, number = model.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, found in chunks(batch.column(1), SPACED_LOWER, RUN_BYTES):
                docs = rows.stop - rows.start
                number += 1
                h, at = with_ends(found)
                doc = np.repeat(np.arange(docs), np.diff(at))
                w, c = m.codes(h)
                v = contexts(w, at)
                keys = np.where((v >= 0) & (w >= 0), v << 32 | w, -1)
                place = np.minimum(np.searchsorted(m.common, keys), max(len(m.common) - 1, 0))
                near = (m.common[place] == keys) if len(m.common) else np.zeros(len(keys), bool)
                # Rare words are scored where their bigrams are looked up; what seen bigrams gain comes on top.
                known = w >= 0
                lp = np.where(known, np.log10(m.p1[np.maximum(w, 0)]), 0.0) + np.where(v >= 0, np.log10(m.back[np.maximum(v, 0)]), 0.0)
                lp[near] = np.log10(discounted(m.common_counts[place[near]], m.d2) * m.seen[v[near]])
                sums = [np.bincount(doc, x, docs) for x in (known & (c > 0), np.where(known, m.base(c), 0.0), lp)]
                ids = batch.column(0).slice(rows.start, docs)
                own = [np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.diff(at), *(x.view(np.int64) for x in sums)]
                own = np.stack([x.astype(np.int64) for x in own]).tobytes()
                v, w, doc = v[~near], w[~near], doc[~near]
                u, pair = pair_ids(v, w)
                pair, at, often = np.unique(pair, return_inverse=True, return_counts=True)
                v, w = (u[pair // len(u)], u[pair % len(u)]) if len(u) else (v, w)
                part = _home(v, w, parts)
                order = np.lexsort((v, w < 0, part))  # frequent words first: their codes compress
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                of = doc[np.argsort(rank[at] * docs + doc)].astype(np.uint32)
                v, w, often = v[order], w[order], often[order].astype(np.uint32)
                ends = np.concatenate([[0], np.cumsum(often, dtype=np.int64)])
                edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                some = [p for p in range(parts) if edges[p] < edges[p + 1]]
                blocks = [pack(*(c[edges[p] : edges[p + 1]] for c in (v, often, w)), of[ends[edges[p]] : ends[edges[p + 1]]]) for p in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, number), pa.int64()), pa.array([number % parts, *some], pa.int32()),
                    pa.array([None, *blocks], pa.binary()), pa.array([own] + [None] * n, pa.binary()),
                ], names=["run", "part", "block", "own"])

    return run


def _look_up(model):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Blocks of one partition against its table -> what they add to the texts of each run: n_known, base, score. Runs' own
        sums pass through."""
        m = model.value
        tables = [unpack(b) for b in _blocks(known)] or [[np.zeros(0, np.int64)] * 4]
        v, n, w, c = tables[0]  # a table per partition
        first, total, kept, unigram, p = _context_sums(m, v, n, w, c)
        heads, words = v[first], np.unique(w)
        frequent = heads >= 0
        seen, back = weights(total, kept, unigram)
        seen[frequent], back[frequent] = m.seen[heads[frequent]], m.back[heads[frequent]]
        of_head = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        keys = of_head * len(words) + np.searchsorted(words, w)
        gains = np.log10(discounted(n, m.d2) * seen[of_head]) - np.log10(back[of_head]) - p
        out: dict[int, list[np.ndarray]] = {}
        asks = [r for r in zip(*(asked.column(c) for c in ("run", "block", "own")), strict=True)] if asked.num_rows else []
        for number, block, own in asks:
            if own.is_valid:
                continue
            v, often, w, of = unpack(block.as_py())
            gain, c = np.zeros(len(v)), np.zeros(len(v), np.int64)
            if len(keys):
                i, j = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((heads, v), (words, w)))
                head = heads[i] == v
                key = i * len(words) + j
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = head & (words[j] == w) & (keys[at] == key)
                gain[hit] = gains[at[hit]]
                c[head] = total[i[head]]  # a word occurs as often as it is a context
                gain[head & (v < 0)] += np.log10(back[i[head & (v < 0)]])
            gain += np.where(v < 0, m.word(c), 0.0)
            known_, base = (v < 0) & (c > 0), np.where(v < 0, m.base(c), 0.0)
            docs, where = np.unique(of, return_inverse=True)
            sums = [np.bincount(where, np.repeat(x, often), len(docs)).astype(float) for x in (known_, base, gain)]
            out.setdefault(number.as_py(), []).append([docs, *(x.view(np.int64) for x in sums)])
        rows = [(k, pack(*(np.concatenate(c) for c in zip(*x, strict=True))), None) for k, x in out.items()] + [(r.as_py(), None, o.as_py()) for r, _, o in asks if o.is_valid]
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("run", pa.int64()), ("sums", pa.binary()), ("own", pa.binary())))})

    return run


def _sum_runs(table: pa.Table) -> pa.Table:
    """A run's own sums and what all partitions add to them -> a row per text."""
    own = next(o.as_buffer() for o in table.column("own") if o.is_valid)
    valid, ids, n_tokens, *sums = np.frombuffer(own, np.int64).reshape(6, -1)
    sums = [x.view(np.float64) for x in sums]
    for block in table.column("sums"):
        if block.is_valid:
            docs, *more = unpack(block.as_py())
            sums = [x + np.bincount(docs, y.view(np.float64), len(x)) for x, y in zip(sums, more, strict=True)]
    return pa.table({"id": pa.array(ids, mask=valid == 0), "n_tokens": n_tokens, "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})


def _word_blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = rare(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy()
            part = _part(keys, parts)
            order = np.lexsort((keys, part))
            keys, n, part = keys[order], n[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(keys[edges[p] : edges[p + 1]], n[edges[p] : edges[p + 1]].astype(np.uint32)) for p in some], pa.binary())], names=["part", "block"])

    return run


class Katz:
    """A bigram model of `training`, a DataFrame with one text column. Its tables are stored in the shared folder: words
    (word, n), and bigram counts with those of their rare words, in partitions by context, or by bigram where the context is
    one of the `vocabulary` most frequent words. Every word and bigram counts, whatever `vocabulary` is. The driver holds only tables of fixed size."""

    def __init__(self, training: DataFrame, vocabulary: int = VOCABULARY) -> None:
        spark = training.sparkSession
        self.spark = spark
        text = training.toDF("text")
        self.words = written(text.mapInArrow(_unigrams, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        few = {r[0]: (r[1], r[2]) for r in self.words.groupBy(F.least("n", F.lit(DISCOUNTED + 2)).alias("n")).agg(F.count("*"), F.sum("n")).collect()}
        total, types = sum(x[1] for x in few.values()), sum(x[0] for x in few.values())
        d1 = discounts(np.array([0, *(few.get(r, (0, 0))[0] for r in range(1, DISCOUNTED + 2))], float))
        step = F.floor(F.log2("n") * STEPS)
        low = least_count(dict(tuple(r) for r in self.words.groupBy(step.alias("step")).count().collect()), vocabulary)
        top = self.words.filter(step >= low).orderBy(F.desc("n"), "word").collect()  # no more than `vocabulary`
        end = self.words.filter(F.col("word") == int(END_HASH.view(np.int64))).collect()
        ranked = [(int(END_HASH), end[0][1] if end else 0)] + [(r[0] & ((1 << 64) - 1), r[1]) for r in top if r[0] & ((1 << 64) - 1) != int(END_HASH)]
        ids = np.array([END, *range(FIRST, FIRST + len(ranked) - 1)], np.int64)
        hashes, counts = np.array([r[0] for r in ranked], np.uint64), np.array([r[1] for r in ranked], np.int64)
        # Discounts leave mass for unknown words; where they leave none, one token's share is set aside.
        kept = sum(float(discounted(np.array([r]), d1)[0]) * few.get(r, (0, 0))[0] for r in range(1, DISCOUNTED + 1)) + few.get(DISCOUNTED + 2, (0, 0))[1]
        # Counts of exactly DISCOUNTED + 1 are in a row of their own.
        kept += (DISCOUNTED + 1) * few.get(DISCOUNTED + 1, (0, 0))[0]
        shrink = min(1.0, (total - total / (total + 1)) / kept) if kept else 1.0
        unknown = 1 - kept * shrink / total if total else 1.0
        p1 = np.zeros(FIRST + len(ranked))
        p1[ids] = np.where(counts > 0, discounted(np.maximum(counts, 1), d1) * shrink / max(total, 1), 0)
        p1[END] = p1[END] or unknown  # an empty training text
        p1[START] = 1.0  # never predicted
        order = np.argsort(hashes)
        n = len(p1)
        model = Model(hashes[order], ids[order], counts[order], total, types, d1, np.ones(DISCOUNTED + 1), p1, shrink, unknown, np.zeros(n), np.ones(n), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts = max(12, total // PARTITION_TOKENS)
        sent = spark.sparkContext.broadcast(model)
        blocks = text.mapInArrow(_bigram_blocks(sent, self.parts), "part int, block binary")
        summed = blocks.repartition(self.parts, "part").groupBy("part").applyInArrow(_sum_blocks, "part int, block binary, few array<long>, by_step array<long>")
        counts = bucketed(summed, "counts", "part", self.parts)
        sweep(spark)
        low = least_count({r[0]: r[1] for r in counts.select(F.posexplode("by_step")).groupBy("pos").agg(F.sum("col")).collect()}, COMMON)
        counted = counts.agg(*(F.sum(F.get("few", F.lit(i))) for i in range(DISCOUNTED + 1))).first()
        model.d2 = discounts(np.array([0, *(x or 0 for x in counted)], float))
        asked = counts.select("part", "block").mapInArrow(_ask_counts(self.parts), "part int, home int, block binary")
        known = self.words.mapInArrow(_word_blocks(self.parts), "part int, block binary")
        told = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_tell_counts, "home int, part int, block binary")
        full = told.groupBy("home").cogroup(counts.select("part", "block").groupBy("part")).applyInArrow(_with_counts(self.parts), "part int, block binary")
        self.table = bucketed(full, "bigrams", "part", self.parts)
        forget(counts)
        sweep(spark)
        sent = spark.sparkContext.broadcast(model)
        sums = self.table.select("block").mapInArrow(_contexts(sent), "v long, n double, kept double, unigram double")
        for v, c, kept_, unigram in sums.groupBy("v").agg(F.sum("n"), F.sum("kept"), F.sum("unigram")).collect():  # a row per id at most
            model.seen[v], model.back[v] = weights(c, kept_, unigram)
        common = self.table.select("block").mapInArrow(_common(low), "key long, n long").collect()  # no more than COMMON
        common.sort()
        model.common, model.common_counts = (np.array([r[i] for r in common], np.int64) for i in (0, 1))
        self.model = model

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each whole text's log10 probability: id, n_tokens (words and one end), n_known (tokens of the training text),
        base (smoothed unigrams) and score. Null and empty texts are one end. Rows that repeat an id are scored alone.
        Runs of texts are numbered by their place, so docs should be a stored table, which a repeated task reads alike."""
        sent = self.spark.sparkContext.broadcast(self.model)
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        asked = base.mapInArrow(_score_runs(sent, self.parts), ASKED)
        found = asked.groupBy("part").cogroup(self.table.groupBy("part")).applyInArrow(_look_up(sent), "run long, sums binary, own binary")
        return found.groupBy("run").applyInArrow(_sum_runs, "id long, n_tokens long, n_known long, base double, score double")
