"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.shared import written
from quadweave.llm.words import SPACE_WORD, mixed, mix

#: Words of a block; slots of an output shard; times that a source may be repeated at most.
BLOCK, SHARD, MOST = 128, 4096, 3.0
#: Shards that one task fills (more only where that would make over TASKS tasks), and that one running sum spans.
FILLED, TASKS, SPAN = 32, 10_000, 1024


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares all sizes out by weight; a source gets no more than `most` times its size, and what is over is shared out
    again by weight among the others until no share is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else per * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of index i in a pseudorandom permutation of range(n): a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> np.uint64(half), x[walk] & low
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64(mixed(key + 0x51ED * r))) & low)
        x[walk] = left << np.uint64(half) | right
        walk = x >= n
    return x.astype(np.int64)


def _keyed(c: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))


class Mixture:
    """slots: (shard, slot, source_key, epoch, block), the mix's blocks in output order; pieces: which words of which
    document (row, first, words) lie in each block; documents: one row per document with its source's size and target.

    Slots are made from a far smaller table of draws, by whose size Spark would take them for small and broadcast them;
    joins with them are sort-merge joins on (source, block), which spread a source over all tasks."""

    def __init__(self, slots: DataFrame, pieces: DataFrame, documents: DataFrame) -> None:
        self.slots, self.pieces, self.documents = slots, pieces, documents

    def blocks(self) -> DataFrame:
        """The mix itself: for each slot, the ranges of words that fill it, by a join on (source, block)."""
        return self.slots.hint("merge").join(self.pieces, ["source_key", "block"])

    def taken(self) -> DataFrame:
        """documents with `taken`: words that the mix takes, repeats counted. Slots are counted per block before the join."""
        times = self.slots.groupBy("source_key", "block").agg(F.count("*").alias("times")).hint("merge")
        words = self.pieces.join(times, ["source_key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.documents.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, most: float = MOST, seed: int = 7) -> Mixture:
    """Takes words from sources in proportion to weights: sources by code point, null last, weigh `weights` in turn.

    A source's documents, by id, form one stream of words that is cut into blocks; only its last block may be short. The
    mix has as many slots of a source as its target needs, to half a block. Output shards draw their source counts from a
    multinomial distribution; draws beyond a source's slots go to sources that are short, so totals are exact. Slot i of a
    source takes a block by a pseudorandom permutation, a new one after each pass over all blocks, so a block is taken at
    most `most` times. All draws depend on the seed alone. Texts that are null or without words have size 0 and are never
    taken; rows that repeat an id are documents of their own; an empty table gives an empty mix.

    Streams are laid out by ranges of (source, id), so that a large source has many tasks; offsets come from sums per
    range. Only one row per source comes to the driver."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _keyed(source_col).alias("source_key"), size.alias("size"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    laid = written(written(sized, "sizes").repartitionByRange(F.col("source_key"), F.col("id"), F.col("size")).withColumn("range", F.spark_partition_id()), "laid")
    by_range = laid.groupBy("source_key", "range").agg(F.sum("size").alias("n"))
    ahead = by_range.select("source_key", "range", (F.sum("n").over(Window.partitionBy("source_key").orderBy("range")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("source_key", "range").orderBy("id", "size", *(f"carry_{c}" for c in carry)).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.join(ahead, ["source_key", "range"]).withColumn("at", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    placed = written(placed.select(F.struct("source_key", "range", F.row_number().over(inside).alias("n")).alias("row"), *sized.columns, "at"), "placed")

    known = sorted(((r[0], r[1]) for r in laid.groupBy("source_key").agg(F.sum("size")).collect()), key=lambda x: (x[0] == "n", x[0]))
    keys, sizes = [k for k, _ in known], [int(n) for _, n in known]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(keys))], most)
    blocks = [-(-n // block) for n in sizes]
    quota = np.array([min(round(t * b / n), int(most * b)) if n else 0 for t, b, n in zip(want, blocks, sizes, strict=True)], np.int64)
    total = int(quota.sum())
    chance = quota / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for j in frame["id"]:
                got = np.random.default_rng([seed, int(j)]).multinomial(min(shard, total - int(j) * shard), chance)
                yield pd.DataFrame({"shard": j, "s": np.flatnonzero(got), "n": got[got > 0]})

    shards = -(-total // shard)
    drawn = written(spark.range(shards).mapInPandas(draw, "shard long, s long, n long"), "drawn")
    drawn_per = np.zeros(len(keys), np.int64)
    for s, n in drawn.groupBy("s").agg(F.sum("n")).collect():
        drawn_per[s] = n
    over, short = np.maximum(drawn_per - quota, 0), np.maximum(quota - drawn_per, 0)
    over_at, short_at = np.cumsum(over) - over, np.cumsum(short)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for j, s, n, first, slot in frame[["shard", "s", "n", "first", "slot"]].itertuples(index=False):
                i = np.arange(first, first + n)
                source = np.full(n, s)
                extra = i >= quota[s]
                e = i[extra] - quota[s] + over_at[s]
                to = np.searchsorted(short_at, e, "right")
                source[extra], i[extra] = to, drawn_per[to] + e - (short_at[to] - short[to])
                epoch, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for x in np.unique(source):
                    at = source == x
                    epoch[at] = i[at] // blocks[x]
                    for p in np.unique(epoch[at]):
                        now = at & (epoch == p)
                        place[now] = permuted(i[now] % blocks[x], blocks[x], mixed(seed * 1000003 + int(x) * 101 + int(p)))
                yield pd.DataFrame({"shard": j, "slot": slot + np.arange(n), "source_key": [keys[x] for x in source], "epoch": epoch, "block": place})

    spans = drawn.withColumn("span", F.floor(F.col("shard") / SPAN))
    before = spans.groupBy("s", "span").agg(F.sum("n").alias("in_span"))
    before = before.select("s", "span", (F.sum("in_span").over(Window.partitionBy("s").orderBy("span")) - F.col("in_span")).alias("before"))
    starts = spans.join(before, ["s", "span"]).withColumn("first", F.col("before") + F.sum("n").over(Window.partitionBy("s", "span").orderBy("shard")) - F.col("n"))
    starts = starts.repartition(max(1, min(TASKS, -(-shards // FILLED))), "shard")  # by number, as the rows' size says nothing of the slots
    starts = starts.withColumn("slot", F.sum("n").over(Window.partitionBy("shard").orderBy("s")) - F.col("n"))
    slots = starts.mapInPandas(fill, "shard long, slot long, source_key string, epoch long, block long")

    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.filter("size > 0").select("row", "source_key", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("row", "source_key", "block", (begin - F.col("at")).alias("first"), (end - begin).alias("words"))
    per = spark.createDataFrame([(k, n, t) for k, n, t in zip(keys, sizes, want, strict=True)], "source_key string, source_size long, target double")
    return Mixture(slots, pieces, placed.join(per, "source_key").select("row", "id", "source", "size", "source_size", "target", *(F.col(f"carry_{c}").alias(c) for c in carry)))
