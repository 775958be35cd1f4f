"""Substring deduplication: words covered by windows that occur elsewhere, found with an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.fmindex import repeated_windows
from quadweave.llm.shared import checked, weighed, written
from quadweave.llm.words import SPACED, Words, chunks, mix

#: Words of a window; words of the runs whose least hash routes a window; words of a shard's index, about.
WINDOW, ANCHOR, SHARD_WORDS = 35, 12, 300_000
#: An anchor that occurs more often routes each of its windows by the window's own words, over many shards.
OFTEN = 500


def _hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, whether or not they cross from one text to the next."""
    n = max(len(h) - k + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    return mix(total + np.uint64(k))


def pieces(found: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Cuts the windows of each text into pieces: neighbours whose anchor, the run of `anchor` words with the least hash
    (the first of equals), lies at the same place. Equal windows have equal anchors at equal places, so all windows that
    could be equal share an anchor. Returns text, first window, last window (as places of words in the batch), anchor."""
    g = _hashes(found.hashes, anchor)
    n = len(found.hashes) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    place = np.lib.stride_tricks.sliding_window_view(g, window - anchor + 1).argmin(axis=1)[:n] + np.arange(n)
    doc = np.repeat(np.arange(len(found.counts)), found.counts)[:n]
    valid = np.flatnonzero(np.arange(n) + window <= found.at[doc + 1])
    place, doc = place[valid], doc[valid]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(valid) else valid
    last = np.append(new[1:], len(valid)) - 1
    return doc[new], valid[new], valid[last] if len(valid) else valid, g[place[new]]


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, text) -> (anchor, rid, n): the numbers of a text's pieces with that anchor"""
        for batch in batches:
            for part, found in chunks(batch.column(1), SPACED):
                doc, _, _, key = pieces(found, window, anchor)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                order = np.lexsort((key, doc))
                doc, key, number = doc[order], key[order], number[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else doc
                rid = batch.column(0).slice(part.start, part.stop - part.start)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(number, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), rid.take(pa.array(doc[new])), lists], names=["anchor", "rid", "n"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, numbers, some) -> (rid, bits, some_bits): sets of small numbers as bitmaps"""

    def bits(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            at = x.values.to_numpy(zero_copy_only=False)
            flags = np.zeros(int(at.max()) + 1 if len(at) else 0, bool)
            flags[at] = True
            out.append(np.packbits(flags).tobytes())
        return pa.array(out, pa.binary())

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), bits(batch.column(1)), bits(batch.column(2))], names=["rid", "bits", "some_bits"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rid, lists of bounds of runs) -> the same with sorted, disjoint runs: whole copies become one run"""
    for batch in batches:
        out = []
        for row in batch.column(2):
            bounds = row.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            first, last = bounds[np.argsort(bounds[:, 0], kind="stable")].T
            reach = np.maximum.accumulate(last)
            new = np.concatenate([[True], first[1:] > reach[:-1]])
            ends = np.append(np.flatnonzero(new)[1:], len(first)) - 1
            out.append(np.stack([first[new], reach[ends]], axis=1).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "rid", "windows"])


def _flags(bits: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8))[:n]
    out[: len(flags)] = flags
    return out


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most 500, since a text has many pieces."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _cut(window: int, anchor: int):
    def cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Rows (id, rid, text, bits, often) -> (row, number, first word, route, words) of the chosen pieces of each text; a
        piece of a frequent anchor is cut into its windows, each routed by its words."""
        for part, found in chunks(batch.column(2), SPACED):
            doc, first, last, key = pieces(found, window, anchor)
            start = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
            data = found.data
            for d in np.flatnonzero(np.diff(start)).tolist():
                a, b, i, number = int(start[d]), int(start[d + 1]), part.start + d, 0
                chosen, often = (_flags(batch.column(c)[i].as_py(), b - a) for c in (3, 4))
                at, to = int(found.at[d]), int(found.at[d + 1])
                tokens = data[found.first[at] : found.last[to - 1]].tobytes().split()
                for p in np.flatnonzero(chosen).tolist():
                    x, y = int(first[a + p]) - at, int(last[a + p]) - at
                    for lo, hi in ((z, z) for z in range(x, y + 1)) if often[p] else ((x, y),):
                        words = b" ".join(tokens[lo : hi + window])
                        route = int.from_bytes(hashlib.md5(words).digest()[:8], "little") if often[p] else int(key[a + p])
                        yield i, number, lo, route, words
                        number += 1

    return cut


def _where(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chosen pieces without their words: (id, rid, number, first, route, digest)"""
        for batch in _small(batches):
            row, number, first, route, digest = [], [], [], [], []
            for i, k, lo, r, words in _cut(window, anchor)(batch):
                row.append(i)
                number.append(k)
                first.append(lo)
                route.append(r)
                digest.append(hashlib.md5(words).digest())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()), pa.array(first, pa.int32()), pa.array(np.array(route, np.uint64).view(np.int64)), pa.array(digest, pa.binary())], names=["id", "rid", "number", "first", "route", "digest"])

    return run


def _words_of(window: int, anchor: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, rid, text, bits, often, wanted, twice) -> the words of the wanted pieces: (shard, copies, piece)"""
        for batch in _small(batches):
            shard, copies, text = [], [], []
            flags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, k, _, r, words in _cut(window, anchor)(batch):
                if i not in flags:
                    flags = {i: tuple(np.unpackbits(np.frombuffer(batch.column(c)[i].as_py(), np.uint8)) for c in (5, 6))}
                wanted, twice = flags[i]
                if k < len(wanted) and wanted[k]:
                    shard.append(r % shards)
                    copies.append(2 if k < len(twice) and twice[k] else 1)
                    text.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(copies, pa.int32()), pa.array(text, pa.binary()).cast(pa.string())], names=["shard", "copies", "piece"])

    return run


def _search(window: int):
    def run(shard: pa.Table) -> pa.Table:
        """Pieces of one shard -> (digest, windows): which windows of a piece occur elsewhere, as bounds of their runs."""
        shard = shard.combine_chunks()
        texts, copies = shard.column("piece").combine_chunks(), shard.column("copies").to_numpy()
        parts = [found for _, found in chunks(texts, SPACED)]
        lengths = np.concatenate([f.counts for f in parts]).astype(np.int64)
        symbols = np.unique(np.concatenate([f.hashes for f in parts]), return_inverse=True)[1].astype(np.int64) + 1
        found = repeated_windows(symbols, lengths, copies, window)
        out = {}
        for i, f in enumerate(found):
            if f.any():
                out[hashlib.md5(texts[i].as_buffer()).digest()] = np.flatnonzero(np.diff(np.concatenate([[0], f, [0]]))).astype(np.int32)
        return pa.table({"digest": pa.array(list(out), pa.binary()), "windows": pa.array(list(out.values()), pa.list_(pa.int32()))})

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, often: int = OFTEN, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows as (id, rid, text), and per row with any the windows of `window` words whose words also
    occur elsewhere, in the same text or another: (id, rid, windows), bounds of runs of first words.

    rid is a hash of id and text; rows that repeat both are equal texts and get equal results. Null texts have no words.

    Windows are routed by anchors, so that windows that may be equal meet in one shard and each is looked at once. Pieces
    whose anchor occurs once in the corpus cannot repeat and are left out. Of equal pieces only one is sent to its shard,
    with a note that there are more. An anchor with more than `often` places routes every window by its own words
    instead, so that a passage of a third of all documents is spread over the shards."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    places = written(base.select("rid", "text").mapInArrow(_anchors(window, anchor), "anchor long, rid long, n array<int>"), "anchors")
    counts = places.groupBy("anchor").agg(F.sum(F.size("n")).alias("count")).filter("count > 1")
    shared = written(counts.select("anchor", (F.col("count") > often).alias("hot")), "shared_anchors")
    lists = places.join(shared, "anchor").groupBy("rid").agg(F.flatten(F.collect_list("n")).alias("numbers"), F.flatten(F.collect_list(F.when(F.col("hot"), F.col("n")))).alias("often"))
    chosen = written(lists.select("rid", "numbers", "often").mapInArrow(_bitmaps, "rid long, bits binary, some_bits binary"), "chosen")
    rows = base.join(weighed(chosen, 48 + F.octet_length("bits") + F.octet_length("some_bits"), limit), "rid").select("id", "rid", "text", "bits", F.col("some_bits").alias("often"))
    where = written(rows.mapInArrow(_where(window, anchor), "id long, rid long, number int, first int, route long, digest binary"), "where")
    one = where.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "number")).alias("at"))
    sent = one.groupBy("at.rid").agg(F.collect_set("at.number").alias("numbers"), F.collect_set(F.when(F.col("copies") > 1, F.col("at.number"))).alias("twice"))
    wanted = written(sent.mapInArrow(_bitmaps, "rid long, bits binary, some_bits binary").select("rid", F.col("bits").alias("wanted"), F.col("some_bits").alias("twice")), "wanted")
    shards = int(where.count() * (window + 12) // shard_words) + 1
    rep_rows = rows.join(weighed(wanted, 48 + F.octet_length("wanted") + F.octet_length("twice"), limit), "rid").select("id", "rid", "text", "bits", "often", "wanted", "twice")
    sent_pieces = rep_rows.mapInArrow(_words_of(window, anchor, shards), "shard long, copies int, piece string")
    found = sent_pieces.groupBy("shard").applyInArrow(_search(window), "digest binary, windows array<int>")
    shifted = F.transform("windows", lambda x: x + F.col("first"))
    spans = where.select("id", "rid", "first", "digest").join(found, "digest").groupBy("id", "rid").agg(F.collect_list(shifted).alias("windows"))
    return base, written(spans.mapInArrow(_merged, "id long, rid long, windows array<int>"), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True, **settings) -> DataFrame:
    """Removes the words that windows of repeated_spans() cover: id, n_words, n_removed, kept_sha256 (of the kept words
    joined by blanks), kept_text (with_text) and removed, as ranges of words. Windows are judged on the input."""
    base, spans = repeated_spans(docs, id_col, text_col, window, **settings)
    width = spans.agg(F.avg(F.size("windows"))).first()[0] or 0
    right = checked(spans.select(F.col("id").alias("__id"), F.col("rid").alias("__rid"), "windows"), int(64 + 4 * width), settings.get("limit"))
    joined = base.join(right, F.col("id").eqNullSafe(F.col("__id")) & (F.col("rid") == F.col("__rid")), "left").select("id", "text", "windows")
    schema = "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<a:int,b:int>>" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests, ranges, texts = [], [], [], [], []
            for text, windows in zip(batch.column(1), batch.column(2), strict=True):
                tokens = (text.as_py() or "").encode().split()
                edge = np.zeros(len(tokens) + 1, np.int64)
                if windows.is_valid:
                    bounds = windows.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, bounds[::2], 1)
                    np.add.at(edge, bounds[1::2] + window - 1, -1)
                out = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], out, [0]])))
                ranges.append([{"a": int(a), "b": int(b)} for a, b in turns.reshape(-1, 2)])
                stops = np.concatenate([[0], turns, [len(tokens)]]).reshape(-1, 2).tolist()
                kept = b" ".join(b" ".join(tokens[a:b]) for a, b in stops if a < b)
                total.append(len(tokens))
                gone.append(int(out.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["id", "n_words", "n_removed", "kept_sha256", "removed"] + ["kept_text"] * with_text)

    return joined.mapInArrow(run, schema)
