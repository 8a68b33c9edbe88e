"""Evaluation and monitoring aggregates: index percentiles, precision and recall, pass rates, counters and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_percentiles(df: DataFrame, value: str, by: Sequence[str] = (), points: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """The value at 0-based index floor(n * p / 100) of the sorted values, per group, and the average.

    Equal values are counted first, so a hot group is ordered by its distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    keys = list(by) or [F.lit(1)]
    through = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v"))
    total = F.sum("_n").over(W.partitionBy(*keys))
    rows = counts.withColumn("_through", through).withColumn("_total", total)
    picks = [
        F.min(F.when(F.col("_through") > F.least(F.floor(F.col("_total") * p / 100), F.col("_total") - 1), F.col("_v"))).alias(f"p{p}") for p in points
    ]
    return rows.groupBy(*by).agg(*picks, (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("avg"))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def precision_recall(found: DataFrame, wanted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall of distinct found rows against wanted ones; empty denominators give 1."""
    a = found.select(*by, *keys).distinct().withColumn("_f", F.lit(1))
    b = wanted.select(*by, *keys).distinct().withColumn("_w", F.lit(1))
    both = a.join(b, [*by, *keys], "full")
    sums = both.groupBy(*by).agg(
        F.count(F.when(F.col("_f").isNotNull() & F.col("_w").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("_w").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"),
    )
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))


def recall_at(ranked: DataFrame, points: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Share of queries with a relevant row among the first k; ranked: (query, rank from 1, relevant)."""
    best = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"))
    return best.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in points])


def counters_and_gauges(samples: DataFrame) -> DataFrame:
    """name, labels, value: counters add up, gauges keep the latest; samples: (name, type, labels, value, ts)."""
    latest = F.max_by("value", "ts")
    return samples.groupBy("name", "type", "labels").agg(F.when(F.col("type") == "counter", F.sum("value")).otherwise(latest).alias("value"))


def against_baseline(results: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Percent difference of each row to the baseline row."""
    base = results.where(F.col(key) == baseline).agg(F.max(value).alias("_base"))
    return results.crossJoin(F.broadcast(base)).select(key, value, (ratio(F.col(value) - F.col("_base"), F.col("_base")) * 100).alias("percent"))  # one row


def history_trend(history: DataFrame, at: str, value: str, by: str) -> DataFrame:
    """Change of a value against the run before, per series."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(at))
    return history.withColumn("before", before).withColumn("delta", F.col(value) - F.col("before"))
