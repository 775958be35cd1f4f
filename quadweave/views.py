"""Materialized views: named, versioned result tables with a row limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Views:
    """Views as Parquet tables under a folder that all executors reach: folder/name/version."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def build(self, name: str, version: str, df: DataFrame, max_rows: int | None = None) -> int:
        """Writes a version and returns its rows; with more than max_rows nothing is kept and an error raised."""
        path = f"{self.folder}/{name}/{version}"
        (df if max_rows is None else df.limit(max_rows + 1)).write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).count()
        if max_rows is not None and rows > max_rows:
            self.delete(name, version)
            raise ValueError(f"view {name} has more than {max_rows} rows")
        return rows

    def activate(self, name: str, version: str) -> None:
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/{name}/_active")

    def read(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.spark.read.schema("version string").json(f"{self.folder}/{name}/_active").first()[0]
        df = self.spark.read.parquet(f"{self.folder}/{name}/{version}")
        df.createOrReplaceTempView(f"view_{name}")
        return df

    def delete(self, name: str, version: str | None = None) -> bool:
        fs, path = self._fs(f"{self.folder}/{name}" + (f"/{version}" if version else ""))
        return fs.delete(path, True)
