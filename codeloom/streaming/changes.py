"""Change-driven maintenance with Structured Streaming: debounce, degrade signal, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import upsert_latest
from .buckets import BucketStore


def debounce(events: DataFrame, key: str, at: str, quiet: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row per key and burst: key, first_seen, last_seen, changes; a burst ends once the key is quiet.

    Works on batch and streaming input; on a stream, rows later than ``late`` are dropped and a
    burst comes out when the watermark passes its end.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, quiet), key).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("changes")
    ).drop("session_window")


def deduplicate(events: DataFrame, keys: list[str], at: str, within: str = "10 minutes") -> DataFrame:
    """Repeated events dropped; on a stream the state of a key is kept for ``within``."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (new, changed, deleted) between two listings (path, mtime, size)."""
    a = before.select("path", F.struct("mtime", "size").alias("a"))
    b = after.select("path", F.struct("mtime", "size").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Event-time counts per tumbling window."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


class IncrementalTable:
    """foreachBatch target: keeps the latest row per key in hash buckets of a shared folder.

    A batch rewrites only the buckets it touches, in one commit, and what holds is read from the
    folder: a replayed batch, one that failed half-way and a new process leave the same rows. A
    row whose ``deleted`` column is true deletes its key; it stays as a mark, so an older version
    that comes late does not bring the key back. A batch that brings ``degrade_at`` keys or more
    calls ``degraded`` once (a full rescan is cheaper then).
    """

    def __init__(self, path: str, keys: list[str], version: str, degrade_at: int = 1000, degraded: Callable[[int], None] | None = None, deleted: str | None = None, buckets: int = 64):
        self.path, self.keys, self.version = path.rstrip("/"), keys, version
        self.degrade_at, self.degraded, self.deleted = degrade_at, degraded, deleted
        self.store = BucketStore(self.path, {"rows": ("", keys)}, buckets)

    def read(self, spark) -> DataFrame | None:
        """The rows that hold, without deleted ones; None before the first batch."""
        if not self.store.tables["rows"][0]:
            schema = self.store.stored_schema(spark, "rows")
            if schema is None:
                return None
            self.store.tables["rows"] = (schema, self.keys)
        rows = self.store.read(spark, "rows")
        return rows if self.deleted is None else rows.where(F.coalesce(F.col(self.deleted), F.lit(False)) == F.lit(False))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.degraded is not None:
            changed = batch.select(*self.keys).distinct().count()
            if changed >= self.degrade_at:
                self.degraded(changed)
        self.store.tables["rows"] = (self.store.stored_schema(spark, "rows") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields), self.keys)
        touched = self.store.touched("rows", batch)
        old = self.store.read(spark, "rows", touched)
        self.store.replace(spark, {"rows": (upsert_latest(old.unionByName(batch), self.keys, self.version), touched)}, batch_id)
