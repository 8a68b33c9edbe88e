"""Links from test methods to methods: explicit, coverage, dependency, naming and shared tags.

Input is a symbol table (class_fqn, class_name, class_doc, method_fqn, method_name, method_doc, path,
imports) with one row per method, built by ``symbols``. Every strategy gives (method, test_method,
strategy, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dir_name
from .store import overlaps

CONFIDENCE = {"explicit": 100, "coverage": 90, "dependency": 80, "naming": 70, "same_tag": 60}
TEST_FOR = r"(?i)@TestFor\s*[:=(]?\s*([\w.]+)\s*\)?"


def is_test_class(name: Column) -> Column:
    return name.rlike(r"(Test|Tests|Spec)$|^Test")


def symbols(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    return (
        methods.select(F.col("class_id"), F.col("full_name").alias("method_fqn"), F.col("name").alias("method_name"), F.col("doc_comment").alias("method_doc"))
        .join(classes.select(F.col("id").alias("class_id"), "file_id", F.col("full_name").alias("class_fqn"), F.col("name").alias("class_name"), F.col("doc_comment").alias("class_doc")), "class_id")
        .join(files.select(F.col("id").alias("file_id"), F.col("absolute_path").alias("path"), "imports"), "file_id", "left")
    )


def _link(df: DataFrame, method: str, test: str, strategy: str) -> DataFrame:
    return df.where(F.col(method) != F.col(test)).select(
        F.col(method).alias("method"), F.col(test).alias("test_method"), F.lit(strategy).alias("strategy"), F.lit(CONFIDENCE[strategy]).alias("confidence")
    ).distinct()


def naming_links(table: DataFrame) -> DataFrame:
    """Class XTest or TestX and class X; a test method equals or contains the method's name, case aside."""
    tested = F.when(F.col("class_name").endswith("Test"), F.regexp_replace("class_name", "Test$", "")).otherwise(F.regexp_replace("class_name", "^Test", ""))
    tests = table.where(F.col("class_name").rlike(r"Test$|^Test") & (F.length("class_name") > 4)).select(
        F.concat(F.regexp_replace("class_fqn", r"[^.]*$", ""), tested).alias("class_fqn"), F.col("method_fqn").alias("test"), F.col("method_name").alias("test_name")
    )
    pairs = table.join(tests, "class_fqn").where((F.length("method_name") > 0) & F.contains(F.lower("test_name"), F.lower("method_name")))
    return _link(pairs, "method_fqn", "test", "naming")


def explicit_links(table: DataFrame) -> DataFrame:
    """@TestFor targets in the method's documentation, else its class's: exact name, dotted ending, or simple name."""
    doc = F.when(F.col("method_doc").rlike(TEST_FOR), F.col("method_doc")).otherwise(F.col("class_doc"))
    named = table.where(doc.rlike(TEST_FOR)).select(
        F.col("method_fqn").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all(doc, F.lit(TEST_FOR), F.lit(1)))).alias("target")
    ).withColumn("target", F.regexp_replace("target", r"(\.class|\.)$", ""))
    ends = table.where(~is_test_class(F.col("class_name"))).select(
        "method_fqn",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("class_fqn", r"\."))), lambda i: F.array_join(F.slice(F.split("class_fqn", r"\."), i, 1000), "."))).alias("target"),
    )
    return _link(named.join(ends, "target"), "method_fqn", "test", "explicit")


def coverage_links(coverage: DataFrame) -> DataFrame:
    """coverage: (test_method, method)."""
    return _link(coverage.select("method", F.col("test_method").alias("t")), "method", "t", "coverage")


def dependency_links(table: DataFrame) -> DataFrame:
    """Test classes in the same directory as the class."""
    tests = table.where(is_test_class(F.col("class_name"))).select(dir_name(F.col("path")).alias("folder"), F.col("method_fqn").alias("test"))
    sources = table.where(~is_test_class(F.col("class_name"))).select(dir_name(F.col("path")).alias("folder"), "method_fqn")
    return _link(sources.join(tests, "folder"), "method_fqn", "test", "dependency")


def tag_links(table: DataFrame, class_tags: DataFrame) -> DataFrame:
    """Test classes that share a tag with the class; class_tags: (class_fqn, tag)."""
    tests = class_tags.join(table.where(is_test_class(F.col("class_name"))).select("class_fqn").distinct(), "class_fqn", "left_semi").select("tag", F.col("class_fqn").alias("test_class"))
    sources = class_tags.join(table.where(~is_test_class(F.col("class_name"))).select("class_fqn").distinct(), "class_fqn", "left_semi")
    pairs = sources.join(tests, "tag").select("class_fqn", "test_class").distinct()
    named = table.select("class_fqn", "method_fqn").join(pairs, "class_fqn").join(table.select(F.col("class_fqn").alias("test_class"), F.col("method_fqn").alias("test")), "test_class")
    return _link(named, "method_fqn", "test", "same_tag")


def gated(links: DataFrame, min_confidence: int = 60) -> DataFrame:
    """Shared-tag links only where a method has fewer than 20 others, dependency links where it has fewer than 10."""
    counts = links.groupBy("method").agg(
        F.count(F.when(F.col("strategy").isin("explicit", "coverage", "naming"), 1)).alias("sure"),
        F.count(F.when(F.col("strategy") == "same_tag", 1)).alias("tagged"),
    )
    rows = links.join(counts, "method")
    with_tags = F.col("sure") + F.when(F.col("sure") < 20, F.col("tagged")).otherwise(0)
    keep = F.when(F.col("strategy") == "same_tag", F.col("sure") < 20).when(F.col("strategy") == "dependency", with_tags < 10).otherwise(F.lit(True))
    return rows.where(keep & (F.col("confidence") >= min_confidence)).select("method", "test_method", "strategy", "confidence")


def covered_methods(blocks: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods (path, start_line, end_line, method) hit by coverage blocks (path, start_line, end_line, count > 0)."""
    hit = blocks.where("count > 0").select("path", F.col("start_line").alias("b1"), F.col("end_line").alias("b2"))
    return methods.join(hit, "path").where(overlaps(F.col("start_line"), F.col("end_line"), F.col("b1"), F.col("b2"))).select("method").distinct()
