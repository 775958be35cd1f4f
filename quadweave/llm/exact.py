"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.shared import ascii_lower, checked, written


def content_key(sha: Column) -> Column:
    """128 bits of content hash: the first half of the SHA-256 digest."""
    return F.unhex(F.substring(sha, 1, 32))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", key: Callable[[Column], Column] = content_key) -> DataFrame:
    """Groups rows whose texts are identical after lower-casing A-Z; a null text counts as empty.

    Returns one row per input row: id, keep_id (the group's smallest id, or largest with keep="max"), group_size, kept,
    text_sha256. Rows that repeat an id and text are all counted, and all marked like their id; a null id is never chosen
    unless the group has no other, and then its rows are kept.

    Small hash rows are written once. Rows whose hash is shared are grouped again by hash and bytes, combined before the
    shuffle, so that a group of copies sends one text per task. A hash found with two texts is a collision; its rows, if
    there are any, are matched by hash and text instead of hash."""
    best = F.min if keep == "min" else F.max
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), sha.alias("sha")).withColumn("h", key(F.col("sha")))
    rows = written(base.select("id", "sha", "h"), "hashes")
    shared = written(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared_hashes")
    texts = base.select("id", "h", "t").join(checked(shared, 64), "h").groupBy("h", "t").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    groups = written(texts.groupBy("h").agg(F.count("*").alias("texts"), best("keep_id").alias("keep_id"), F.sum("n").alias("n")), "groups")
    if groups.filter("texts > 1").isEmpty():
        out = rows.join(groups, "h", "left")
    else:
        clash = groups.filter("texts > 1").select("h")
        apart = base.join(clash, "h", "left_semi")
        inside = apart.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
        out = rows.join(clash, "h", "left_anti").join(groups, "h", "left").select("id", "sha", "keep_id", "n")
        out = out.union(apart.join(inside, ["h", "t"]).select("id", "sha", "keep_id", "n"))
    own = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", own.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), own.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
