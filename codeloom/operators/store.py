"""Store operations on immutable tables: upserts, replacement by owner, cascades, tags, lookups and diffs.

Each takes the existing rows and a batch and returns the new rows; the writer swaps or overwrites
the touched partitions. Ids are stable hashes of the natural key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category of each known tag; any other is of the business category.
TAG_CATEGORY = {
    "layer": ("controller", "service", "dao", "domain", "infra", "repository", "handler", "middleware", "config"),
    "test": ("unit", "integration", "e2e", "mock"),
    "lang": ("go", "java", "python", "typescript", "javascript", "cpp", "rust", "kotlin", "scala", "ruby", "php"),
    "risk": ("legacy", "todo", "deprecated", "performance", "security"),
    "tech": ("cache", "mq", "retry", "transactional", "async", "schedule", "batch"),
}


def stable_id(*key: Column) -> Column:
    return F.xxhash64(*key)


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch replace those of the same key; null keys match each other.

    Of several batch rows of a key the one with the greatest other columns is kept, by column order.
    """
    rows = existing.alias("e").join(batch.select(*keys).distinct().alias("b"), _null_safe(keys), "left_anti")
    return rows.select("e.*").unionByName(_greatest(batch, keys))


def _greatest(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    return batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*batch.columns)


def _null_safe(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for key in keys:
        on &= F.col(f"e.{key}").eqNullSafe(F.col(f"b.{key}"))
    return on


def upsert_latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, the one of the greatest version; ties go to the greatest other columns."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    packed = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row"))
    return packed.select(*keys, "_row.*").select(*rows.columns)


def replace_by_owner(existing: DataFrame, batch: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """All children of the touched owners are replaced by those of the batch; owners: (owner) touched, else the batch's."""
    touched = (batch if owners is None else owners).select(owner).distinct()
    return existing.join(touched, owner, "left_anti").unionByName(batch)


def cascade_delete(file_ids: DataFrame, files: DataFrame, classes: DataFrame, methods: DataFrame, calls: DataFrame, class_tags: DataFrame, method_tags: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given files (id) and what belongs to them."""
    gone = file_ids.select("id").distinct()
    gone_classes = classes.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id")
    gone_methods = methods.join(gone_classes.withColumnRenamed("id", "class_id"), "class_id", "left_semi").select("id")
    return {
        "file": files.join(gone, "id", "left_anti"),
        "class": classes.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti"),
        "method": methods.join(gone_methods, "id", "left_anti"),
        "call": calls.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti"),
        "class_tag": class_tags.join(gone_classes.withColumnRenamed("id", "class_id"), "class_id", "left_anti"),
        "method_tag": method_tags.join(gone_methods.withColumnRenamed("id", "method_id"), "method_id", "left_anti"),
    }


def changed_files(stored: DataFrame, scanned: DataFrame, key: str = "absolute_path", digest: str = "content_hash") -> DataFrame:
    """Scanned rows whose hash is new or differs from the stored one."""
    old = stored.select(key, F.col(digest).alias("_old"))
    return scanned.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals share a point; an interval that ends before it starts shares none."""
    return (a_start <= a_end) & (b_start <= b_end) & (a_start <= b_end) & (b_start <= a_end)


def entity_diff(old: DataFrame, new: DataFrame, name: str = "name", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """name, action: DELETE, INSERT, UPDATE (same name, overlapping lines) or RELOCATE (same name elsewhere)."""
    a = old.select(F.col(name).alias("name"), F.col(start).alias("a1"), F.col(end).alias("a2"))
    b = new.select(F.col(name).alias("name"), F.col(start).alias("b1"), F.col(end).alias("b2"))
    action = (
        F.when(F.col("b1").isNull(), "DELETE").when(F.col("a1").isNull(), "INSERT")
        .when(overlaps(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")), "UPDATE").otherwise("RELOCATE")
    )
    return a.join(b, "name", "full").select("name", action.alias("action"))


def link_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Methods (file_id, class_fqn, ...) with class_id by qualified name within the file; others are dropped."""
    keys = classes.select("file_id", F.col("full_name").alias("class_fqn"), F.col("id").alias("class_id"))
    return methods.join(keys, ["file_id", "class_fqn"])


def write_back_docs(rows: DataFrame, docs: DataFrame, key: str = "id", column: str = "doc_comment") -> DataFrame:
    """Documentation replaced where the second table (key, column) has one."""
    new = docs.groupBy(key).agg(F.max(column).alias("_doc"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_doc", column)).drop("_doc").select(*rows.columns)


def tag_category(tag: Column) -> Column:
    out = F.lit("biz")
    for category, names in TAG_CATEGORY.items():
        out = F.when(tag.isin(*names), category).otherwise(out)
    return out


def upsert_tags(links: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """(owner, tag) links: the owners of the batch get exactly its tags, each once."""
    return replace_by_owner(links, batch.where("tag is not null and tag != ''").dropDuplicates([owner, "tag"]), owner, batch)


def tags_and(links: DataFrame, owner: str, tags: Sequence[str]) -> DataFrame:
    """Owners that have all the tags (relational division); repeated tags count once, none or an empty one is an error."""
    wanted = list(dict.fromkeys(tags))
    if not wanted or "" in wanted:
        raise ValueError("no tags given")
    return links.where(F.col("tag").isin(wanted)).groupBy(owner).agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted)).select(owner)


def tag_counts(links: DataFrame) -> DataFrame:
    return links.groupBy(tag_category(F.col("tag")).alias("category")).agg(F.countDistinct("tag").alias("tags"), F.count(F.lit(1)).alias("links"))


def symbol_kind(symbols: DataFrame, classes: DataFrame, methods: DataFrame, files: DataFrame, symbol: str = "symbol") -> DataFrame:
    """symbol, kind, file of ids written ``class:<id>``, ``method:<id>`` or ``file:<path>``; unknown ones keep empty fields."""
    kind = F.regexp_extract(symbol, r"^(class|method|file):", 1)
    number = F.try_to_number(F.regexp_extract(symbol, r"^(?:class|method):(\d{1,18})$", 1), F.lit("9" * 18)).cast("bigint")
    keyed = symbols.select(F.col(symbol).alias("symbol"), kind.alias("kind"), number.alias("number"), F.regexp_extract(symbol, r"^file:(.*)$", 1).alias("path"))
    of_class = classes.join(files.select(F.col("id").alias("file_id"), F.col("absolute_path").alias("file")), "file_id", "left").select(F.col("id").alias("class_id"), "file")
    places = of_class.select(F.lit("class").alias("kind"), F.col("class_id").alias("number"), "file").unionByName(
        methods.select("id", "class_id").join(of_class, "class_id").select(F.lit("method").alias("kind"), F.col("id").alias("number"), "file")
    )
    return keyed.join(places, ["kind", "number"], "left").select(
        "symbol", "kind", F.coalesce(F.when(F.col("kind") == "file", F.col("path")), "file", F.lit("")).alias("file")
    )


def index_documents(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(doc_id, content): a document per class and per method, and per file without classes."""
    path = files.select(F.col("id").alias("file_id"), "absolute_path")
    of_class = classes.join(path, "file_id", "left").select(
        F.concat(F.lit("class:"), "id").alias("doc_id"), F.concat_ws(" ", "full_name", "type", "doc_comment", "absolute_path").alias("content")
    )
    of_method = methods.select(F.concat(F.lit("method:"), "id").alias("doc_id"), F.concat_ws(" ", "full_name", "signature", "doc_comment").alias("content"))
    bare = path.join(classes.select("file_id").distinct(), "file_id", "left_anti").select(F.concat(F.lit("file:"), "absolute_path").alias("doc_id"), F.col("absolute_path").alias("content"))
    return of_class.unionByName(of_method).unionByName(bare)
