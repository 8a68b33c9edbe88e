"""Readers for the code-metadata tables and the record-version rules they share.

A record (by ``id``) may be delivered several times. Its *current* row has the latest
``indexed_at`` (null counts as earliest), its *first arrival* is the earliest ``indexed_at``,
and it is *live* when the current row has a null ``deleted_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_name(name: Column) -> Column:
    """Trimmed name; null where it refers to nothing (null, empty or blank)."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def current_rows(df: DataFrame, columns: Sequence[str], key: str = "id", version: str = "indexed_at") -> DataFrame:
    """One row per key: ``columns`` of the current version and ``first_arrival``.

    Rows without a key are dropped (they name no record). Of versions with the same time the
    greatest row by column order is kept, so repeated and tied rows give one defined result.
    The aggregation combines map-side, hence a record repeated millions of times costs one
    partial row per task.
    """
    rest = [c for c in dict.fromkeys(columns) if c not in (key, version)]
    packed = F.struct(F.col(version).alias(version), *[F.col(c).alias(c) for c in rest])
    grouped = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(F.max(packed).alias("_current"), F.min(version).alias("first_arrival"))
    )
    return grouped.select(key, *[F.col(f"_current.{c}").alias(c) for c in [version, *rest]], "first_arrival")


def live_rows(df: DataFrame, columns: Sequence[str], key: str = "id", version: str = "indexed_at", deleted: str = "deleted_at") -> DataFrame:
    """``current_rows`` restricted to records whose current row is not deleted."""
    return current_rows(df, [*columns, deleted], key, version).where(F.col(deleted).isNull()).drop(deleted)
