"""Change feeds: coalescing, resuming, refresh queues, and incremental index updates by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of keys that a state table is kept in; a batch writes those that it touches.
BUCKETS = 32


def coalesced(changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """One change per key: the latest, but a delete wins over all of the batch."""
    last = F.max_by(F.struct(*(F.col(c) for c in changes.columns)), F.struct(*order))
    rows = changes.groupBy(*keys).agg(last.alias("x"), F.bool_or(F.col(op) == "delete").alias("gone"))
    return rows.select(*(F.when(F.col("gone"), "delete").otherwise(F.col(f"x.{c}")).alias(c) if c == op else F.col(f"x.{c}").alias(c) for c in changes.columns))


def matching(changes: DataFrame, topics: list[str], topic: str = "topic") -> DataFrame:
    return changes.filter(F.col(topic).isin(topics))


def since(feed: DataFrame, sequence: int, topics: list[str] | None = None, kept: int | None = None) -> tuple[DataFrame, bool]:
    """What a subscriber that saw `sequence` has missed, in order, and whether it must read everything anew instead: the feed
    keeps `kept` changes (all by default), and what follows `sequence` may be gone."""
    last = feed.agg(F.max("sequence")).first()[0] or 0
    resync = kept is not None and sequence < last - kept or sequence > last
    rows = feed.filter(F.col("sequence") > sequence)
    return (matching(rows, topics) if topics is not None else rows).orderBy("sequence"), bool(resync)


def dirty(latest: DataFrame, applied: DataFrame, keys: list[str]) -> DataFrame:
    """The refresh queue of a derived index: keys whose version (column version) is not the applied one (column applied), with
    their lag, the furthest behind first."""
    both = latest.join(applied, keys, "left").withColumn("lag", F.col("version") - F.coalesce("applied", F.lit(0)))
    return both.filter("applied is null or applied < version").orderBy(F.desc("lag"), *keys)


def reconciled(desired: DataFrame, applied: DataFrame, keys: list[str]) -> DataFrame:
    """What is to be done about each source: missing (not applied yet), failed (to be tried again), stale (another profile is
    applied), applied, or unwanted (applied, but no longer desired)."""
    a = applied.select(*keys, F.col("profile").alias("own_"), F.col("error").alias("error_"), F.lit(True).alias("there_"))
    both = desired.withColumn("wanted_", F.lit(True)).join(a, keys, "full_outer")
    state = F.when(F.col("wanted_").isNull(), "unwanted").when(F.col("there_").isNull(), "missing").when(F.col("error_").isNotNull(), "failed").when(F.col("profile") != F.col("own_"), "stale").otherwise("applied")
    return both.select(*keys, state.alias("state"))


def merged(state: DataFrame, changes: DataFrame, keys: list[str], op: str = "op") -> DataFrame:
    """State after a batch of coalesced changes: touched keys are replaced, deleted ones go."""
    kept = state.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.filter(F.col(op) != "delete").select(*state.columns))


def bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def apply_batch(spark, folder: str, batch: DataFrame, n: int, keys: list[str], order: list[str], value: list[Column], op: str = "op") -> DataFrame:
    """Applies batch n of changes to the state table in folder, and returns its coalesced changes.

    The buckets that the batch touches are written under folder/v=<n>, and then their numbers under folder/touched/v=<n>,
    which makes the version count. A batch that is run again writes the same. value must hold the keys."""
    from quadweave.storage import cut

    new = cut(coalesced(batch, keys, order, op))
    rows = new.select(*value, op)
    touched = sorted(r[0] for r in rows.select(bucket(keys)).distinct().collect())  # BUCKETS at most
    old = _buckets(spark, folder, n, touched)
    out = rows.filter(F.col(op) != "delete").drop(op) if old is None else merged(old, rows, keys, op)
    out.withColumn("bucket", bucket(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={n}")
    # Buckets that have become empty have no files; a version's schema is kept beside them.
    out.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/touched/v={n}")
    return new


def sync(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str], value: list[Column], op: str = "op", after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Applies all changes that are available to a state table and stops; after gets each batch's coalesced changes, to update
    other indexes (facts, text, vectors) of the same keys. The query's checkpoint keeps the offsets, from which a later call
    resumes."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        new = apply_batch(spark, folder, batch, n, keys, order, value, op)
        if after:
            after(new, n)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _buckets(spark, folder: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The latest version of each bucket, or the latest one before a batch; None if there is none."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(f"{folder}/touched")):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(at(f"{folder}/touched")) if s.getPath().getName().startswith("v=") and fs.exists(at(f"{s.getPath()}/_SUCCESS"))]
    done = [int(v[2:]) for v in done if before is None or int(v[2:]) < before]
    if not done:
        return None
    marks = spark.read.parquet(*(f"{folder}/touched/v={v}" for v in done)).select("bucket", F.regexp_extract(F.input_file_name(), r"/v=(\d+)/", 1).cast("long").alias("v"))
    latest = [tuple(r) for r in marks.groupBy("bucket").agg(F.max("v")).collect() if only is None or r[0] in only]
    schema = spark.read.parquet(f"{folder}/schema").schema
    paths = [p for b, v in latest if fs.exists(at(p := f"{folder}/v={v}/bucket={b}"))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def state(spark, folder: str) -> DataFrame | None:
    """The state table; None if no batch was applied."""
    return _buckets(spark, folder)
