"""Tables in the folder that driver and executors share: intermediate ones, and quads laid out for scans."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files' groups that predicates are dealt to by hash; a pattern with a known predicate reads one of them.
GROUPS = 64


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to the context; only a local session may do without, in its warehouse."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", "") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not shared and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, its size is known to the plans that read it, and a lost
    executor loses nothing of it. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{str(folder(spark)).rstrip('/')}/quadweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def group_of(p: Column) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(GROUPS)).cast("int")


@dataclass(frozen=True)
class Layout:
    """Quads stored in groups of predicates, sorted by predicate, subject and object, so that a scan reads one group and skips
    row groups by their bounds. The same four terms are one row."""

    spark: SparkSession
    folder: str

    def load(self, quads: DataFrame, mode: str = "overwrite") -> None:
        """Bulk load. Of the same four terms the row of the first source stays. A predicate's quads are dealt to several
        tasks by subject, so that one that most quads have does not meet in one of them."""
        from quadweave.operators.update import once

        rows = once(quads).withColumn("pg", group_of(F.col("p")))
        rows.repartition("pg", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("pg", "p", "s", "o").write.mode(mode).partitionBy("pg").parquet(self.folder)

    def quads(self) -> DataFrame:
        from quadweave.sources.datasets import QUADS

        return self.spark.read.schema(f"{QUADS}, pg int").parquet(self.folder)

    def statistics(self) -> DataFrame:
        """Files, bytes and quads of each group of predicates."""
        q = self.quads().select("pg", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
        files = q.groupBy("pg", "f").agg(F.max("b").alias("b"), F.count("*").alias("n"))
        return files.groupBy("pg").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("quads"))
