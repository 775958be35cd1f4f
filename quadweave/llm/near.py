"""Near-duplicate groups: Circulant MinHash, banding, exact Jaccard verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.components import components
from quadweave.llm.minhash import BANDS, K_WORDS, ROWS, shingle_sets, sign_batches
from quadweave.llm.shared import checked, written
from quadweave.llm.words import SPACED_LOWER, chunks

#: Texts on one side of a tile; a bucket of n sets is compared in (n / TILE) ** 2 / 2 tiles of at most twice as many texts.
TILE = 512


def linked_pairs(sets: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Index pairs (i, j) with denominator * |intersection| >= numerator * |union|, from exact intersection sizes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one text adds to no intersection
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    common = np.zeros((n, n), np.float32)
    width = max(1, (8 << 20) // n)
    for lo in range(0, int(often.sum()), width):
        part = (column >= lo) & (column < lo + width)
        has = np.zeros((n, min(width, int(often.sum()) - lo)), np.float32)
        has[row[part], column[part] - lo] = 1
        common += has @ has.T
    both = common.astype(np.int64)
    near = denominator * both >= numerator * (sizes[:, None] + sizes[None, :] - both)
    return np.argwhere(np.triu(near, 1) & (sizes > 0)[:, None])


def forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones left apart: enough to connect all that the pairs connect."""
    over = list(range(len(ids)))

    def top(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = top(i), top(j)
        if a != b:
            over[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _verify(k: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, lo, hi, id, text) sorted by tile -> links (a, b) of each tile."""
        tile, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            links = forest(np.array(ids), linked_pairs(sets, numerator, denominator)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            at = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            own = batch.column(3).to_pylist()
            for part, found in chunks(batch.column(4), SPACED_LOWER):
                for i, s in zip(range(part.start, part.stop), shingle_sets(found, k), strict=True):
                    if at[i] != tile:
                        yield done()
                        tile, ids, sets = at[i], [], []
                    ids.append(own[i])
                    sets.append(s)
        yield done()

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 75, denominator: int = 100, k: int = K_WORDS, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """Components of the documents whose sets of k-word shingles have a Jaccard similarity of numerator/denominator or more.

    Returns one row per input row: id, n_shingles, component_id (the smallest id reachable), kept (id = component_id).
    Empty texts, and rows with a null id, are linked with nothing; rows that repeat an id belong to one document.

    Documents of equal sets become one class (128-bit digests of whole sets), so copies meet only in pre-aggregated
    groups. Classes that share a band are compared exactly, on whole texts, in tiles of bounded size, with no cap on
    bucket sizes; buckets of the same members are compared once. A tile returns a spanning forest of its links, never all
    pairs. At a similarity of 0.75, 24 bands of 3 rows miss a pair with a chance of 2e-6."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(lambda it: sign_batches(it, bands, rows, k), "id long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    classes = written(signed.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("rep", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).filter("n > 1")
    chosen = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / tile).cast("int")
    placed = entries.join(chosen, "key").select("rep", "key", parts.alias("parts"), F.pmod(F.xxhash64("rep", F.lit(2)), parts).cast("int").alias("block"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = written(placed.select("rep", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "tiles")
    small = checked(tiles, 64)
    texts = base.join(small, base["id"] == small["rep"]).select("key", "lo", "hi", "id", "text")
    texts = texts.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    links = texts.mapInArrow(_verify(k, numerator, denominator), "a long, b long")
    groups = components(links)
    merged = classes.select("set_key", "rep").join(groups, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    merged = written(merged, "merged")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.join(merged, "set_key", "left").select("id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept"))
