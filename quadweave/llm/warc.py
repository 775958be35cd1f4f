"""WARC records and their fixity audit: Merkle trees over ordered record ranges, compared between replicas."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.shared import written

#: Children of a tree node, and levels of nodes above the records; a shard file holds FAN_OUT ** LEVELS ids.
FAN_OUT, LEVELS = 16, 3

_HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <urn:record:{id}>\r\nContent-Length: {length}\r\n\r\n"
_TAIL = "\r\n\r\n"


def record(id_: Column, uri: Column, body: Column) -> Column:
    """The bytes of a WARC response record, as a string column; null uri and body count as empty."""
    body = F.coalesce(body, F.lit(""))
    parts = {"uri": F.coalesce(uri, F.lit("")), "id": F.coalesce(id_.cast("string"), F.lit("")), "length": F.octet_length(body).cast("string")}
    head = [parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", _HEAD)]
    return F.concat(*head, body, F.lit(_TAIL))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, body, offset, length) of each record of a WARC file; stops with ValueError at bytes that are no record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        stop = end + 4 + n + 4
        if data[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"a record that starts at byte {at} is cut short")
        yield headers, data[end + 4 : end + 4 + n], at, stop - at
        at = stop


def leaves(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """(shard, slot, id, digest, length, copies): one row per distinct record. A shard holds a range of ids; records without
    an id are spread over shards below 0 by their digests. Rows that repeat a record are one leaf with their number in
    copies; rows of one id that differ are leaves of one slot. Null and empty bodies are records of their own length, long
    ones are hashed whole, an empty table has no leaves, and other columns of pages are not looked at."""
    span = FAN_OUT**LEVELS
    id_ = F.col(id_col).cast("long")
    text = record(id_, F.col(uri_col), F.col(body_col))
    rows = pages.select(id_.alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    rows = rows.groupBy("id", "digest", "length").agg(F.count("*").alias("copies"))
    shard = F.coalesce(F.floor(F.col("id") / span), -1 - _digits("digest", 0, 7))
    return rows.select(shard.alias("shard"), F.coalesce(F.pmod("id", F.lit(span)), _digits("digest", 7, 3)).alias("slot"), "id", "digest", "length", "copies")


def _digits(digest: str | Column, first: int, n: int) -> Column:
    """Some hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, first + 1, n), 16, 10).cast("long")


def tree(records: DataFrame) -> list[DataFrame]:
    """Node tables (side, shard, node, up, hash) of both replicas, from the level above the slots up to the roots. A node's
    hash covers the number of bytes of its range and its children's hashes in order, so one root stands for all ordered
    ranges. The records of one slot have no order: their hashes are combined by exclusive or, in any number of tasks.

    Each level is written once, and read to make the next one and to compare."""
    leaf = F.sha2(F.concat_ws(":", "digest", F.col("copies").cast("string")), 256)
    parts = [F.bit_xor(_digits("leaf", 15 * i, 15)).alias(f"x{i}") for i in range(4)]
    slots = records.withColumn("leaf", leaf).groupBy("side", "shard", F.col("slot").alias("node")).agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"), F.count("*").alias("n"), *parts)
    texts = [F.col(c).cast("string") for c in ("bytes", "n", "x0", "x1", "x2", "x3")]
    below = slots.select("side", "shard", "node", "bytes", F.sha2(F.concat_ws("|", *texts), 256).alias("hash"))
    out = []
    for i in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FAN_OUT at most
        hashes = F.array_join(F.transform(children, lambda c: F.concat_ws("/", c["node"].cast("string"), c["hash"])), ",")
        node = below.groupBy("side", "shard", F.floor(F.col("node") / FAN_OUT).alias("up")).agg(F.sum("bytes").alias("bytes"), hashes.alias("h"))
        below = written(node.select("side", "shard", F.col("up").alias("node"), "bytes", F.sha2(F.concat_ws("|", F.col("bytes").cast("string"), "h"), 256).alias("hash")), f"level{i}")
        out.append(below)
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compares two replicas' leaves() from the roots down and returns the records that differ.

    id, shard, first_byte and length of the range in our shard file (null for a record that only they have), status:
    `altered` (the id is on both sides, with other bytes or another number of copies), `missing` (only ours), `extra` (only
    theirs); our_digest and their_digest. Where an id has several records that differ, each is paired with one of the other
    side, in order of digest, and what is left over is missing or extra. Records without an id have nothing to be paired by.
    Branches with equal hashes are not entered. Empty replicas have no roots and differ in nothing."""
    columns = ["shard", "slot", "id", "digest", "length", "copies"]
    both = ours.select(F.lit(0).alias("side"), *columns).union(theirs.select(F.lit(1).alias("side"), *columns))
    levels = tree(both)
    bad = None
    for level in reversed(levels):
        nodes = level
        if bad is not None:
            nodes = nodes.withColumn("up", F.floor(F.col("node") / FAN_OUT)).join(bad, ["shard", "up"], "left_semi")
        hashes = [F.max(F.when(F.col("side") == i, F.col("hash"))) for i in (0, 1)]
        bad = nodes.groupBy("shard", F.col("node").alias("up")).agg(*(h.alias(n) for h, n in zip(hashes, "ab", strict=True)))
        bad = written(bad.filter(~F.col("a").eqNullSafe(F.col("b"))).select("shard", "up"), "mismatches")
    in_file = Window.partitionBy("side", "shard").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, -1)
    files = both.join(bad.select("shard").distinct(), "shard", "left_semi")
    placed = files.withColumn("first_byte", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(in_file), F.lit(0)))
    near = placed.withColumn("up", F.floor(F.col("slot") / FAN_OUT)).join(bad, ["shard", "up"], "left_semi")
    alone = near.groupBy(*columns).agg(F.count("*").alias("sides"), F.max("side").alias("side"), F.max("first_byte").alias("first_byte")).filter("sides = 1")
    order = F.row_number().over(Window.partitionBy("side", "shard", "id").orderBy("digest", "copies"))
    lone = F.when(F.col("id").isNull(), F.struct("side", "digest"))
    of = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    met = alone.select("*", order.alias("n"), lone.alias("lone")).groupBy("id", "shard", "n", "lone").agg(
        of(0, "first_byte").alias("first_byte"), of(0, "length").alias("length"), of(0, "digest").alias("our_digest"), of(1, "digest").alias("their_digest"))
    status = F.when(F.col("their_digest").isNull(), "missing").when(F.col("our_digest").isNull(), "extra").otherwise("altered")
    return met.select("id", "shard", "first_byte", "length", status.alias("status"), "our_digest", "their_digest")
