"""Zones of Parquet tables: save, load, describe, and compute once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lake:
    """Named tables under ``root/raw`` and ``root/processed``, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, processed: bool = True) -> str:
        return f"{self.root}/{'processed' if processed else 'raw'}/{name}"

    def save(self, df: DataFrame, name: str, processed: bool = True, partition_by: list[str] | None = None) -> str:
        path = self.path(name, processed)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def load(self, name: str, processed: bool = True) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(name, processed))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def once(self, name: str, compute: Callable[[], DataFrame], force_refresh: bool = False) -> DataFrame:
        """The stored table; computed and stored first if it is missing or a refresh is forced."""
        if not force_refresh:
            found = self.load(name)
            if found is not None:
                return found
        self.save(compute(), name)
        return self.load(name)

    def info(self, processed: bool = True) -> DataFrame:
        """One row per table: files, size in MB (2 dp) and last change. Only file metadata is read."""
        zone = f"{self.root}/{'processed' if processed else 'raw'}"
        return file_info(self.spark, zone, depth="/([^/]+)/[^/]*$")


def file_info(spark: SparkSession, folder: str, depth: str = "/([^/]+)\\.parquet(?:/.*)?$") -> DataFrame:
    """One row per table of a folder: a Parquet file, or a folder of them with such a name."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return files.groupBy(F.regexp_extract("path", depth, 1).alias("name")).agg(
        F.count(F.lit(1)).alias("files"),
        F.bround(F.sum("length") / 1048576, 2).alias("size_mb"),
        F.max("modificationTime").alias("modified"),
    )


def describe(df: DataFrame, name: str) -> DataFrame:
    """Row and column count of a table. Counting Parquet rows reads footers only."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def shapes(spark, folder: str) -> DataFrame:
    """``describe`` of every Parquet table in a folder; empty for a folder without any. The driver learns the names only."""
    names = sorted(r["name"] for r in file_info(spark, folder).select("name").distinct().collect())
    out = spark.createDataFrame([], "name string, rows long, columns int")
    for name in names:
        out = out.unionByName(describe(spark.read.parquet(f"{folder}/{name}.parquet"), name))
    return out
