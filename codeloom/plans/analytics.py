"""Queries over the order and event tables: evaluation aggregates, event-time operators and relational extras."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, store
from ..streaming import changes
from ..tables import table


def latency_percentiles(spark, d):
    return metrics.index_percentiles(table(spark, d, "events"), "value", ["event_type"]).select("event_type", "p50", "p95", "p99", F.round("avg", 6).alias("avg"))


def precision_recall(spark, d):
    events = table(spark, d, "events")
    found = events.where("event_type = 'click'").select(F.floor(F.col("user_id") / 50).alias("bucket"), "user_id")
    wanted = events.where("event_type = 'purchase'").select(F.floor(F.col("user_id") / 50).alias("bucket"), "user_id")
    return metrics.precision_recall(found, wanted, ["user_id"], ["bucket"]).select("bucket", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def recall_at_k(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    ranked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.row_number().over(order).alias("rank"), (F.col("l_returnflag") == "R").alias("relevant"))
    return metrics.recall_at(ranked).select("queries", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 3, 5)])


def counters_and_gauges(spark, d):
    samples = table(spark, d, "events").select(
        F.col("event_type").alias("name"), F.when(F.col("event_type").isin("click", "view"), "counter").otherwise("gauge").alias("type"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "value", F.struct("ts", "event_id").alias("ts"),
    ).withColumn("labels", F.to_json("labels"))
    return metrics.counters_and_gauges(samples).withColumn("value", F.round("value", 4))


def baseline_percent(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    return metrics.against_baseline(rows, "p_brand", "price", "Brand#11").select("p_brand", F.round("price", 4).alias("price"), F.round("percent", 4).alias("percent"))


def history_trend(spark, d):
    months = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.history_trend(months, "month", "n", "o_orderpriority").where("before is not null")


def debounce_sessions(spark, d):
    return changes.debounce(table(spark, d, "events"), "user_id", "ts", "6 hours").select("user_id", "first_seen", "last_seen", "changes")


def tumbling_counts(spark, d):
    return changes.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


def snapshot_diff(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"), F.length("o_orderpriority").alias("size"), "o_custkey")
    before = orders.where("o_custkey % 7 != 0").drop("o_custkey")
    after = orders.where("o_custkey % 5 != 0").withColumn("size", F.when(F.col("o_custkey") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))).drop("o_custkey")
    return changes.snapshot_changes(before, after)


def interval_overlap(spark, d):
    """Orders whose life span (order date to last shipment) overlaps that of the customer's next order."""
    spans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("end"))
    rows = table(spark, d, "orders").join(spans, "o_orderkey")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = rows.withColumn("next_start", F.lead("o_orderdate").over(order)).withColumn("next_end", F.lead("end").over(order))
    return pairs.where(store.overlaps(F.col("o_orderdate"), F.col("end"), F.col("next_start"), F.col("next_end"))).select("o_orderkey")


def left_join_counts(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


def paged_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


def rollup_revenue(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.grouping_id().alias("level"))
    return rows.select("l_returnflag", "l_linestatus", F.round("q", 2).alias("q"), F.col("level").cast("int").alias("level"))


def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def window_rank(spark, d):
    order = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").withColumn("r", F.row_number().over(order)).where("r <= 3").select("s_nationkey", "s_suppkey", "r")


def set_operations(spark, d):
    orders = table(spark, d, "orders")
    a, b = orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_orderstatus = 'O'").select("o_custkey")
    part = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return part(a.intersect(b), "intersect").unionByName(part(a.subtract(b), "except")).unionByName(part(a.union(b).distinct(), "union"))


def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


def nation_revenue(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = (
        table(spark, d, "lineitem").select("l_orderkey", net.alias("net"))
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("net").alias("net"))
    )
    return rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("net", 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        latency_percentiles, precision_recall, recall_at_k, counters_and_gauges, baseline_percent, history_trend, debounce_sessions, tumbling_counts, snapshot_diff,
        interval_overlap, left_join_counts, paged_orders, rollup_revenue, cube_counts, window_rank, set_operations, pricing_summary, nation_revenue,
    )
}

ORACLES = {
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = n * 50 // 100 THEN value END) AS p50, max(CASE WHEN i = n * 95 // 100 THEN value END) AS p95, max(CASE WHEN i = n * 99 // 100 THEN value END) AS p99, round(avg(value), 6) AS avg FROM r GROUP BY event_type""",
    "precision_recall": """WITH a AS (SELECT DISTINCT user_id // 50 AS bucket, user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id // 50 AS bucket, user_id FROM events WHERE event_type = 'purchase'),
j AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, a.user_id AS f, b.user_id AS w FROM a FULL JOIN b ON a.user_id = b.user_id),
s AS (SELECT bucket, count(CASE WHEN f IS NOT NULL AND w IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN w IS NULL THEN 1 END) AS fp, count(CASE WHEN f IS NULL THEN 1 END) AS fn FROM j GROUP BY bucket)
SELECT bucket, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall FROM s""",
    "recall_at_k": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rank, l_returnflag = 'R' AS rel FROM lineitem),
b AS (SELECT l_orderkey, min(CASE WHEN rel THEN rank END) AS best FROM r GROUP BY l_orderkey)
SELECT count(*) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_3, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_5 FROM b""",
    "counters_and_gauges": """SELECT event_type AS name, CASE WHEN event_type IN ('click', 'view') THEN 'counter' ELSE 'gauge' END AS type, '{"user":"' || user_id || '"}' AS labels,
round(CASE WHEN event_type IN ('click', 'view') THEN sum(value) ELSE max_by(value, (ts, event_id)) END, 4) AS value FROM events GROUP BY event_type, user_id""",
    "baseline_percent": """WITH r AS (SELECT p_brand, avg(p_retailprice) AS price FROM part GROUP BY p_brand), b AS (SELECT price AS base FROM r WHERE p_brand = 'Brand#11')
SELECT p_brand, round(price, 4) AS price, round((price - base) / base * 100, 4) AS percent FROM r LEFT JOIN b ON true""",
    "history_trend": """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL)
SELECT * FROM (SELECT o_orderpriority, month, n, lag(n) OVER w AS before, n - lag(n) OVER w AS delta FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)) WHERE before IS NOT NULL""",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS changes FROM s GROUP BY user_id, k""",
    "tumbling_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "snapshot_diff": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, length(o_orderpriority) AS size, o_custkey AS c FROM orders)
SELECT path, CASE WHEN c % 7 = 0 THEN 'new' WHEN c % 5 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM o
WHERE (c % 7 = 0 AND c % 5 <> 0) OR (c % 7 <> 0 AND c % 5 = 0) OR (c % 7 <> 0 AND c % 5 <> 0 AND c % 3 = 0)""",
    "interval_overlap": """WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, e FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
p AS (SELECT *, lead(o_orderdate) OVER w AS ns, lead(e) OVER w AS ne FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey FROM p WHERE o_orderdate <= e AND ns <= ne AND o_orderdate <= ne AND ns <= e""",
    "left_join_counts": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "paged_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20",
    "rollup_revenue": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, grouping(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window_rank": "SELECT s_nationkey, s_suppkey, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3",
    "set_operations": """WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT 'intersect' AS name, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "nation_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
