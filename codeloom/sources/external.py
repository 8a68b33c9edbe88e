"""Other sources: SCIP indexes, graph tables, coverage files, run histories, adapter selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCIP_SCHEMA = (
    "documents array<struct<relative_path: string, language: string, symbols: array<struct<id: string, name: string, kind: int, enclosing_symbol: string>>,"
    " occurrences: array<struct<symbol: string, symbol_role: string, range: array<int>>>>>"
)


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of SCIP JSON files."""
    return spark.read.schema(SCIP_SCHEMA).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*")


def scip_records(documents: DataFrame, max_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, calls): path, kind (class, method), name, line; and path, caller, callee, line (the last reference of each symbol).

    References without a definition in the document give no call; the caller is the path.
    """
    docs = documents.limit(max_docs) if max_docs is not None else documents
    symbols = docs.select("relative_path", F.explode("symbols").alias("s")).select("relative_path", "s.*")
    uses = docs.select("relative_path", F.explode("occurrences").alias("o")).select(
        "relative_path", F.col("o.symbol").alias("id"), F.lower("o.symbol_role").alias("role"), (F.try_element_at("o.range", F.lit(1))).alias("line")
    )
    defined = symbols.join(uses.where("role = 'definition'"), ["relative_path", "id"]).select(
        F.col("relative_path").alias("path"), F.when(F.col("kind") == 0, "class").when(F.col("kind") == 1, "method").alias("kind"), "name", "line", "id"
    ).where("kind is not null")
    calls = uses.where("role = 'reference'").groupBy("relative_path", "id").agg(F.max("line").alias("line")).withColumnRenamed("relative_path", "path").join(
        defined.select("path", "id", "name"), ["path", "id"]
    )
    return defined.drop("id"), calls.select("path", F.col("path").alias("caller"), F.col("name").alias("callee"), "line")


def _member(kind: Column, words: str) -> Column:
    return F.lower(kind).isin(*words.split())


def graph_schema(tables: Sequence[str]) -> str:
    """``nodes`` or ``symbols`` by the tables present; anything else is an error."""
    for first in ("nodes", "symbols"):
        if first in tables and "edges" in tables:
            return first
    raise ValueError("neither nodes and edges nor symbols and edges")


def graph_records(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, methods, calls) from node and edge tables; edge ends are looked up by two joins."""
    named = nodes.where("name is not null and name != ''")
    kind = F.lower("kind")
    classes = named.where(_member(F.col("kind"), "class interface struct trait enum module object record")).select(
        "id", "name", "file", F.coalesce("line", F.lit(0)).alias("line"),
        F.when(kind == "interface", "INTERFACE").when(kind.isin("abstract", "trait"), "ABSTRACT").when(kind == "enum", "ENUM").when(kind.isin("object", "module", "record"), "OBJECT").otherwise("CLASS").alias("type"),
    )
    methods = named.where(_member(F.col("kind"), "method function func constructor")).select("id", "name", "file", F.coalesce("line", F.lit(0)).alias("line"))
    call_type = (
        F.when(kind.isin("calls", "call"), "direct").when(kind.isin("extends", "inherits"), "interface")
        .when(kind.isin("imports", "references", "implements"), "dynamic").otherwise("unknown")
    )
    ends = named.select("id", "name")
    calls = edges.select("source_id", "target_id", call_type.alias("call_type")).join(
        ends.select(F.col("id").alias("source_id"), F.col("name").alias("caller")), "source_id"
    ).join(ends.select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id")
    return classes, methods, calls.select("caller", "callee", "call_type")


def caller_files(callers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, path): the first file whose symbol equals the caller or is a dotted prefix of it; an equi-join on prefixes."""
    parts = F.split("caller", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    tried = callers.select("caller").distinct().select("caller", F.explode(prefixes).alias("symbol"))
    return tried.join(symbols.select("symbol", "path"), "symbol").groupBy("caller").agg(F.min("path").alias("path"))


def read_coverprofile(lines: DataFrame, value: str = "value") -> DataFrame:
    """file, start_line, end_line, count from ``file:l.c,l.c n count`` lines; other lines are skipped."""
    form = r"^(.*):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    pick = lambda n: F.regexp_extract(value, form, n)
    return lines.where(F.col(value).rlike(form)).select(
        pick(1).alias("file"), pick(2).cast("int").alias("start_line"), pick(4).cast("int").alias("end_line"), pick(7).cast("bigint").alias("count")
    )


def read_coverage_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """(test_method, method) from JSON objects test -> [methods]; invalid JSON gives no rows."""
    return texts.select(F.explode(F.from_json(value, "map<string,array<string>>")).alias("test_method", "methods")).select("test_method", F.explode("methods").alias("method"))


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, comment lines (#) and blank ones skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def select_adapters(adapters: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(language, adapter): the first of the priority list that supports it, else the first registered; adapters: (adapter, language, position)."""
    ranks = F.array_position(F.array(*[F.lit(p) for p in priority]) if priority else F.array().cast("array<string>"), F.col("adapter"))
    order = W.partitionBy("language").orderBy(F.when(ranks == 0, len(priority) + 1).otherwise(ranks), "position")
    return adapters.withColumn("r", F.row_number().over(order)).where("r = 1").select("language", "adapter")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary source, and of the fallback for keys the primary has none of."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))
