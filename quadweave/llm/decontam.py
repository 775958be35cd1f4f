"""Benchmark decontamination with a positional inverted index of the training documents, kept in shards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.shared import written
from quadweave.llm.words import ALNUM_LOWER, chunks

WINDOW = 10
#: Bytes of text of an index shard, about.
SHARD_BYTES = 1 << 20
#: Bytes of benchmark text compiled at once; a larger benchmark is matched in several blocks, each against all shards.
BLOCK_BYTES = 1 << 20

INDEX = "shard string, ids array<long>, starts array<int>, terms array<long>, term_at array<int>, positions array<int>"

MATCHES = "shard string, row int, id long, n_words long, hits array<struct<a:int,b:int>>, items array<string>, near_items array<string>"


@dataclass(frozen=True)
class Windows:
    """Distinct windows of a block of items. terms: sorted hashes of all words; of[w, i]: term of place i, -1 past the end;
    order[w]: places from the rarest term to the commonest; items of window w: item[item_at[w]:item_at[w + 1]], as indexes
    of names, which are sorted as strings; None, last, stands for items without an id."""

    terms: np.ndarray
    of: np.ndarray
    lengths: np.ndarray
    order: np.ndarray
    item: np.ndarray
    item_at: np.ndarray
    names: list[str | None]


def compile_windows(items: list[tuple[object, str | None]], size: int = WINDOW) -> Windows:
    order = lambda i: (i is None, i or "")
    items = sorted(((i if i is None else str(i), t) for i, t in items), key=lambda x: order(x[0]))
    names = sorted({i for i, _ in items}, key=order)
    index = {n: i for i, n in enumerate(names)}
    seen: dict[tuple, set[int]] = {}
    for part, found in chunks(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER):
        for d, i in enumerate(range(part.start, part.stop)):
            h = found.hashes[found.at[d] : found.at[d + 1]].tolist()
            for j in range(max(len(h) - size + 1, min(len(h), 1))):
                seen.setdefault(tuple(h[j : j + size]), set()).add(index[items[i][0]])
    terms = np.array(sorted({x for w in seen for x in w}), np.uint64)
    of = np.full((len(seen), size), -1, np.int64)
    for w, key in enumerate(seen):
        of[w, : len(key)] = np.searchsorted(terms, np.array(key, np.uint64))
    at = np.concatenate([[0], np.cumsum([len(x) for x in seen.values()])]).astype(np.int64)
    item = np.array([i for x in seen.values() for i in sorted(x)], np.int64)
    return Windows(terms, of, (of >= 0).sum(axis=1), np.zeros_like(of), item, at, names)


def rarest_first(w: Windows, counts: np.ndarray) -> Windows:
    """The same windows with their places ordered by how often each place's term occurs in the index."""
    keys = np.where(w.of >= 0, counts[np.maximum(w.of, 0)], np.iinfo(np.int64).max) if len(w.terms) else w.of
    return Windows(w.terms, w.of, w.lengths, np.argsort(keys, axis=1, kind="stable"), w.item, w.item_at, w.names)


def index_batches(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) -> one row per shard: ids and word offsets of its documents and, for each of the terms that occurs, its
    sorted positions. Position p of the shard is word p of its documents laid end to end."""
    for batch in batches:
        for part, found in chunks(batch.column(1), ALNUM_LOWER, SHARD_BYTES):
            place = np.minimum(np.searchsorted(terms, found.hashes), max(len(terms) - 1, 0))
            known = np.flatnonzero(terms[place] == found.hashes) if len(terms) else np.zeros(0, np.int64)
            order = known[np.argsort(place[known], kind="stable")]
            which, first = np.unique(place[order], return_index=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]),
                pa.array([batch.column(0).slice(part.start, part.stop - part.start).to_pylist()], pa.list_(pa.int64())),
                pa.array([found.at.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([terms[which].view(np.int64)], pa.list_(pa.int64())),
                pa.array([np.append(first, len(order)).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([order.astype(np.int32)], pa.list_(pa.int32())),
            ], names=["shard", "ids", "starts", "terms", "term_at", "positions"])


def intersect(w: Windows, local: np.ndarray, term_at: np.ndarray, positions: np.ndarray, starts: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, document) of all matches in one shard. Candidates come from the postings of each window's rarest term; the
    other terms' postings, adjusted by their offsets, are intersected with them in order of rarity. With slop, each term
    may lie up to that many words off its place, and a match may start before its document."""
    span = int(starts[-1]) + w.of.shape[1] + slop + 1
    keys = np.repeat(local, np.diff(term_at)) * span + positions  # sorted: local is, and so are a term's positions
    slot = np.full(len(w.terms), -1, np.int64)
    slot[local] = np.arange(len(local))
    rows = np.arange(len(w.of))
    rare = slot[w.of[rows, w.order[:, 0]]] if len(rows) else np.zeros(0, np.int64)
    rows, rare = rows[rare >= 0], rare[rare >= 0]
    n = term_at[rare + 1] - term_at[rare]
    at = np.repeat(term_at[rare] - np.cumsum(n) + n, n) + np.arange(n.sum())
    win = np.repeat(rows, n)
    first = positions[at].astype(np.int64)
    doc = np.searchsorted(starts, first, "right") - 1
    begin = first - w.order[win, 0]
    fits = (begin >= starts[doc]) & (begin + w.lengths[win] <= starts[doc + 1]) if not slop else np.ones(len(win), bool)
    win, begin, doc = win[fits], begin[fits], doc[fits]
    for r in range(1, w.of.shape[1]):
        if not len(win):
            break
        place = w.order[win, r]
        term = w.of[win, place]
        low = np.maximum(begin + place - slop, starts[doc])
        high = np.minimum(begin + place + slop, starts[doc + 1] - 1)
        i = np.searchsorted(keys, term * span + low)
        hit = (term < 0) | (keys[np.minimum(i, len(keys) - 1)] <= term * span + high) & (i < len(keys)) & (low <= high)
        win, begin, doc = win[hit], begin[hit], doc[hit]
    return win, begin, doc


def match_batches(batches: Iterator[pa.RecordBatch], w: Windows, slop: int) -> Iterator[pa.RecordBatch]:
    """Index shards -> MATCHES, a row per document: hits are the ranges of words inside exact matches."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, starts, terms, term_at, positions = (batch.column(i)[k].values for i in range(1, 6))
            starts, term_at = starts.to_numpy().astype(np.int64), term_at.to_numpy().astype(np.int64)
            terms, positions = terms.to_numpy().view(np.uint64), positions.to_numpy().astype(np.int64)
            place = np.minimum(np.searchsorted(w.terms, terms), max(len(w.terms) - 1, 0))
            ours = np.flatnonzero(w.terms[place] == terms) if len(w.terms) else np.zeros(0, np.int64)
            sizes = np.diff(term_at)[ours]
            taken = np.repeat(term_at[ours] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            postings = place[ours], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), positions[taken]

            def items(win: np.ndarray, doc: np.ndarray) -> list[list[str | None]]:
                n = w.item_at[win + 1] - w.item_at[win]
                item = w.item[np.repeat(w.item_at[win] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pairs = np.unique(np.repeat(doc, n) * len(w.names) + item)
                out: list[list[str | None]] = [[] for _ in range(len(starts) - 1)]  # noqa: B023
                for p in pairs.tolist():
                    out[p // len(w.names)].append(w.names[p % len(w.names)])
                return out

            win, begin, doc = intersect(w, *postings, starts)
            edge = np.zeros(int(starts[-1]) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + w.lengths[win], -1)
            on = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
            opens = on[1:] & (~on[:-1] | np.isin(np.arange(len(on) - 1), starts))
            closes = on[:-1] & (~on[1:] | np.isin(np.arange(len(on) - 1), starts))
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            at = np.searchsorted(first, starts)
            base = np.repeat(starts[:-1], np.diff(at))
            hits = pa.StructArray.from_arrays([pa.array(x - base, pa.int32()) for x in (first, last)], names=["a", "b"])
            exact = items(win, doc)
            near = items(*intersect(w, *postings, starts, slop)[::2]) if slop else exact
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0)[k].as_py()] * len(ids), pa.string()),
                pa.array(np.arange(len(ids)), pa.int32()),
                ids,
                pa.array(np.diff(starts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), hits),
                pa.array(exact, pa.list_(pa.string())),
                pa.array(near, pa.list_(pa.string())),
            ], names=["shard", "row", "id", "n_words", "hits", "items", "near_items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which documents hold windows of benchmark items: runs of `size` words, or all words of a shorter item.

    Returns one row per document: id, n_words, n_hit (words inside exact matches), items (ids of the items whose windows
    occur, sorted as strings) and near_items (with slop: items with a window all of whose words lie within `slop` of their
    places; else the same as items). Null and empty texts have no words; repeated rows are scored one by one; items
    without an id hit like others and are one null, last, in items, which OP5_SQL counts as one item; items without words match nothing, and without items nothing is hit.

    The postings are stored first, as a table of shards that hold whole documents (about 1 MB of text each), for the
    words of the benchmark: others occur in no window. The benchmark is the query set: it is compiled in blocks of bounded
    size, and each block is matched against all shards."""
    spark = docs.sparkSession
    queries = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")).filter("t is not null")
    n = int((queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes) + 1
    blocks = [compile_windows([(r[0], r[1]) for r in queries.filter(F.pmod(F.xxhash64(F.coalesce("item", "t")), F.lit(n)) == b).collect()], size) for b in range(n)]
    terms = np.unique(np.concatenate([w.terms for w in blocks]))
    sent = spark.sparkContext.broadcast(terms)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = written(base.mapInArrow(lambda it: index_batches(it, sent.value), INDEX), "postings")
    sizes = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.get("term_at", i) - F.get("term_at", i - 1))
    pairs = index.filter(F.size("terms") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("t"), sizes.alias("n"))).alias("p"))
    found = pairs.groupBy("p.t").agg(F.sum("p.n").alias("n")).collect()  # at most one row per word of the benchmark
    counts = dict(zip(np.array([r[0] for r in found], np.int64).view(np.uint64).tolist(), (r[1] for r in found), strict=True))
    parts = []
    for w in blocks:
        ordered = spark.sparkContext.broadcast(rarest_first(w, np.array([counts.get(t, 0) for t in w.terms.tolist()], np.int64)))
        parts.append(index.mapInArrow(lambda it, ordered=ordered: match_batches(it, ordered.value, slop), MATCHES))
    out = parts[0]
    if n > 1:
        several = reduce(DataFrame.union, parts).groupBy("shard", "row", "id", "n_words")
        out = several.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near_items")))
    order = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    sweep = F.aggregate(F.array_sort("hits"), start, lambda s, h: F.struct(F.greatest(s["end"], h["b"]).alias("end"), (s["n"] + F.greatest(h["b"] - F.greatest(h["a"], s["end"]), F.lit(0))).alias("n")), lambda s: s["n"])
    return out.select("id", "n_words", sweep.alias("n_hit"), order("items"), order("near_items"))
