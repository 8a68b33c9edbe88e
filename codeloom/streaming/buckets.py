"""Durable keyed tables in a shared folder: hash buckets, of which a change rewrites only those it touches.

Data lies in one folder per change and table; a log of commits says which change holds a bucket.
A change becomes visible by one appended log file, for all its tables at once, so an attempt that
dies leaves the state before it, also for a process started later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "name string, bucket int, change long, batch long, filled boolean"


@dataclass
class BucketStore:
    """tables: name -> (schema, key columns); ``buckets`` is fixed when the folder is first written."""

    path: str
    tables: dict[str, tuple[str, list[str]]]
    buckets: int = 64

    def bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def _commits(self, spark: SparkSession) -> list:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        last = spark.read.schema(_LOG).parquet(f"{self.path}/commits").groupBy("name", "bucket").agg(
            F.max(F.struct("change", "batch", "filled")).alias("last")
        )
        return last.select("name", "bucket", "last.*").collect()  # one row per table and bucket

    def stored_schema(self, spark: SparkSession, name: str) -> str | None:
        """The schema of the table as written, None before the first change."""
        change = max((r["change"] for r in self._commits(spark) if r["name"] == name and r["filled"]), default=None)
        if change is None:
            return None
        fields = spark.read.parquet(f"{self.path}/{name}/{change:012d}").drop("bucket").schema.fields
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def last_batch(self, spark: SparkSession) -> int | None:
        return max((r["batch"] for r in self._commits(spark) if r["batch"] is not None), default=None)

    def read(self, spark: SparkSession, name: str, touched: list[int] | None = None) -> DataFrame:
        """The table, or its ``touched`` buckets: pruned folders, no other file is opened."""
        schema = self.tables[name][0]
        held: dict[int, list[int]] = {}
        for r in self._commits(spark):
            if r["name"] == name and r["filled"] and (touched is None or r["bucket"] in touched):
                held.setdefault(r["change"], []).append(r["bucket"])
        out = spark.createDataFrame([], schema)
        for change, buckets in sorted(held.items()):
            part = spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}/{change:012d}")
            out = out.unionByName(part.where(F.col("bucket").isin(buckets)).drop("bucket"))
        return out

    def replace(self, spark: SparkSession, new: dict[str, tuple[DataFrame, list[int]]], batch: int | None = None) -> int:
        """New rows of the touched buckets of each table, committed together; the number of the change."""
        change = max((r["change"] for r in self._commits(spark)), default=-1) + 1
        log = []
        for name, (rows, touched) in new.items():
            folder = f"{self.path}/{name}/{change:012d}"
            rows.withColumn("bucket", self.bucket(name)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            filled = {r[0] for r in spark.read.schema(f"{self.tables[name][0]}, bucket int").parquet(folder).select("bucket").distinct().collect()}
            log += [(name, b, change, batch, b in filled) for b in touched]
        if log:
            spark.createDataFrame(log, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return change

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())  # at most ``buckets``
