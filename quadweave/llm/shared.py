"""Intermediate tables in the shared folder, ASCII lower-casing, and joins whose small side is checked before a broadcast."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its rows, at the stated width, stay below this; otherwise the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Rows of an Arrow batch while a table is written, at most.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_writing = threading.RLock()
_scratch: list[list[DataFrame]] = []
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset, and then has
    a folder of its own."""
    conf = spark.sparkContext.getConf()
    if not conf.get("spark.checkpoint.dir", ""):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not getattr(folder, "own", ""):
            folder.own = "file://" + tempfile.mkdtemp(prefix="quadweave-")
        return folder.own
    return conf.get("spark.checkpoint.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing of it. It goes with
    the scratch() it was made in, or when the driver ends."""
    path = f"{folder(df.sparkSession).rstrip('/')}/quadweave/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    with _writing:  # the setting holds for the session
        batch = int(conf.get(_BATCH))
        conf.set(_BATCH, str(min(batch, BATCH_ROWS) if batch > 0 else BATCH_ROWS))  # texts are long rows
        try:
            df.write.parquet(path)
        finally:
            conf.set(_BATCH, str(batch))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    _made(out)
    return out


def _made(df: DataFrame) -> None:
    for tables in _scratch:
        tables.append(df)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def scratch(keep: str = "") -> Iterator[None]:
    """Tables that are made inside are deleted at its end, but for those of the name that is kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            if not keep or f"/{keep}-" not in df.shared_path:
                forget(df)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, in buckets by column, so that joins and cogroups on it need no shuffle of this side.
    Its name is in the session's catalog until forget()."""
    key = f"quadweave_{name}_{uuid.uuid4().hex}"
    path = f"{folder(df.sparkSession).rstrip('/')}/quadweave/{key}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(key)
    out = df.sparkSession.table(key)
    out.shared_path, out.shared_name = path, key
    _made(out)
    return out


def sweep(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage: Spark then removes the shuffle files of finished jobs from all executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes a written() or bucketed() table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    if name := getattr(df, "shared_name", ""):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checked(small: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """small, marked for broadcast if it is below the limit; small should be a written() table, whose count is cheap."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def weighed(small: DataFrame, row_bytes: Column, limit: int | None = None) -> DataFrame:
    """small, marked for broadcast if its rows, by an expression of their bytes, stay below the limit."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(small) if (small.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else small


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts, where lower() does just that, take the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs but for the rows whose id is in the one column of ids; rows without an id stay."""
    drop = checked(ids.toDF("__drop_id"), 32)
    return docs.join(drop, docs[id_col] == drop["__drop_id"], "left_anti")
