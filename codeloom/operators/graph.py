"""Call, inheritance, reference and file graphs as edge DataFrames.

Traversals are frontier loops: join the frontier with the edges, drop what was seen, checkpoint,
until it is empty or the depth is reached. Edges are (src, dst); src calls (or refers to) dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint
from ..tables import clean_name


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct (src, dst) with both names present."""
    return calls.select(clean_name(F.col("caller_fqn")).alias("src"), clean_name(F.col("callee_fqn")).alias("dst")).where(
        "src is not null and dst is not null"
    ).distinct()


def hierarchy_edges(classes: DataFrame) -> DataFrame:
    """Distinct (src class, dst parent); parents may be external."""
    return classes.select(clean_name(F.col("full_name")).alias("src"), F.explode("parent_fqns").alias("p")).select(
        "src", clean_name(F.col("p")).alias("dst")
    ).where("src is not null and dst is not null").distinct()


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in; one shuffle on the node, pre-aggregated."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def graph_size(edges: DataFrame) -> DataFrame:
    counts = degrees(edges)
    return counts.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("edges"))


def orphans(edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls."""
    return degrees(edges).where("n_in = 0").select("node")


def hot_nodes(edges: DataFrame, limit: int = 20) -> DataFrame:
    return degrees(edges).select("node", "n_in").orderBy(F.desc("n_in"), "node").limit(limit)


def adjacency(edges: DataFrame) -> DataFrame:
    """node, callees, callers as sorted arrays (a hot node's array holds all its callers)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("callees"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
    none = F.array().cast("array<string>")
    return out.join(into, "node", "full").select("node", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def k_hop(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "callers") -> DataFrame:
    """node, depth: everything reached from ``starts`` (node) within ``depth`` steps, with its least depth; starts left out."""
    near, far = ("dst", "src") if direction == "callers" else ("src", "dst")
    seen = checkpoint(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias(near)), near, "left_semi").select(F.col(far).alias("node")).distinct()
        frontier = checkpoint(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 100) -> DataFrame:
    """step, node of one shortest path (the least predecessor at each step); no rows if there is none."""
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, node string")
    level = spark.createDataFrame([(start, None, 0)], "node string, prev string, depth int")
    seen, levels, found = checkpoint(level), [level], False
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("prev"))
        frontier = checkpoint(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node", "prev", "depth"))
        levels.append(frontier)
        if not frontier.where(F.col("node") == end).isEmpty():
            found = True
            break
    if not found:
        return spark.createDataFrame([], "step int, node string")
    path = [end]
    for frontier in reversed(levels[1:]):  # one row per step
        path.append(frontier.where(F.col("node") == path[-1]).select("prev").first()[0])
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Edges among the nodes within ``depth`` of the starts in both directions."""
    nodes = k_hop(edges, starts, depth, "callers").unionByName(k_hop(edges, starts, depth, "callees")).select("node").unionByName(starts.select("node")).distinct()
    nodes = checkpoint(nodes)
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def file_nodes(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Per file: id, path, language, classes, methods; files without any have 0."""
    n_class = classes.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("classes"))
    n_method = methods.join(classes.select(F.col("id").alias("class_id"), "file_id"), "class_id").groupBy(F.col("file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("methods")
    )
    return files.select("id", "absolute_path", "language").join(n_class, "id", "left").join(n_method, "id", "left").na.fill(0, ["classes", "methods"])


def reverse_references(files: DataFrame, distinct: bool = True) -> DataFrame:
    """(path, referenced_by) from the stored reference lists; multiplicity kept on request."""
    rows = files.select(F.col("absolute_path").alias("path"), F.explode("referenced_by_files").alias("referenced_by"))
    return rows.distinct() if distinct else rows


def module_summary(files: DataFrame, classes: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, calls, orphans and the language counts as a map."""
    languages = files.groupBy(F.coalesce("language", F.lit("")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    as_map = languages.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
    size = degrees(edges).agg(F.coalesce(F.sum("n_out"), F.lit(0)).alias("calls"), F.count(F.when(F.col("n_in") == 0, 1)).alias("orphan_methods"))
    one = files.agg(F.count(F.lit(1)).alias("files"))
    for name, df in (("classes", classes), ("methods", methods)):
        one = one.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one.crossJoin(size).crossJoin(as_map)


def impact(edges: DataFrame, method: str, depth: int, tests: DataFrame) -> DataFrame:
    """method, depth, related_tests of every caller and callee within depth; tests: (method, test_method)."""
    start = edges.sparkSession.createDataFrame([(method,)], "node string")
    both = k_hop(edges, start, depth, "callers").unionByName(k_hop(edges, start, depth, "callees"))
    nodes = both.groupBy("node").agg(F.min("depth").alias("depth"))
    linked = nodes.join(tests.withColumnRenamed("method", "node"), "node", "left")
    return linked.groupBy(F.col("node").alias("method"), "depth").agg(F.sort_array(F.collect_set("test_method")).alias("related_tests"))


def symbol_dependencies(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(symbol, dependency, kind): direct callees and direct parents."""
    return edges.select(F.col("src").alias("symbol"), F.col("dst").alias("dependency"), F.lit("call").alias("kind")).unionByName(
        parents.select(F.col("src").alias("symbol"), F.col("dst").alias("dependency"), F.lit("parent").alias("kind"))
    )


def nearest_class(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Owner of each (file_id, line, name): the last class that begins at or before its line in the file."""
    rows = classes.select("file_id", F.col("start_line").alias("line"), F.col("full_name").alias("owner"), F.lit(None).cast("string").alias("name")).unionByName(
        methods.select("file_id", "line", F.lit(None).cast("string").alias("owner"), "name")
    )
    order = W.partitionBy("file_id").orderBy("line", F.col("name").isNotNull(), "owner", "name").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("owner", F.last("owner", ignorenulls=True).over(order)).where("name is not null").select("file_id", "line", "name", "owner")
