"""Versioned Parquet tables: a new folder for each version, and a pointer that is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


META = "source_folder string, indexed_at timestamp, snapshot string"


class Store:
    """Tables of one index.  ``meta`` names the live version; readers see a whole version or the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def meta(self) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/meta")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.schema(META).parquet(f"{self.root}/meta").orderBy(F.col("indexed_at").desc(), "snapshot").first()
        return row.asDict() if row else None

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the live version; empty if there is none."""
        meta = self.meta()
        if meta is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{meta['snapshot']}/{name}")

    def new_version(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def stage(self, version: str, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a version that isn't live yet, and read it back: what follows from it is not computed twice."""
        path = f"{self.root}/{version}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, version: str, source_folder: str, keep: int = 2) -> None:
        """Write the pointer to a staged version, then remove all but the newest ``keep`` ones.  Nothing that is read is overwritten."""
        meta = self.spark.range(1).select(F.lit(source_folder).alias("source_folder"), F.current_timestamp().alias("indexed_at"), F.lit(version).alias("snapshot"))
        meta.write.mode("append").parquet(f"{self.root}/meta")
        old = self.spark.read.parquet(f"{self.root}/meta").orderBy(F.col("indexed_at").desc(), "snapshot").select("snapshot").collect()[keep:]  # a row for each version ever written
        for r in old:
            self.discard(r["snapshot"])

    def clear(self) -> None:
        """Forget everything: the pointer goes first, so that no reader meets a half-removed version."""
        self.discard("meta")
        self.discard("")

    def discard(self, name: str) -> None:
        """Remove a version that isn't live, or a table of one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")
