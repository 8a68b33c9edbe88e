"""Tags derived from names, paths and documentation by CASE chains (layer, tech, risk, test, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slashes

# Path segments and class-name endings of the layers.
LAYER_SEGMENTS = {
    "controller": ("controller", "controllers"),
    "service": ("service", "services"),
    "dao": ("dao", "daos", "repository", "repositories"),
    "domain": ("domain", "domains", "model", "models", "entity", "entities"),
    "infra": ("infra", "infrastructure", "config", "configs"),
    "middleware": ("middleware", "middlewares", "filter", "filters", "interceptor", "interceptors"),
    "handler": ("handler", "handlers"),
}
LAYER_ENDINGS = {
    "controller": ("Controller",), "service": ("Service",), "dao": ("Dao", "DAO", "Repository", "Repo"), "domain": ("Domain", "Entity", "Model"),
    "infra": ("Config",), "middleware": ("Middleware", "Filter", "Interceptor"), "handler": ("Handler",),
}
# Words in names, in order of precedence.
TECH_WORDS = (("cache", ("cache",)), ("mq", ("queue", "mq")), ("retry", ("retry",)), ("transactional", ("transaction",)), ("async", ("async",)), ("schedule", ("schedule", "cron")), ("batch", ("batch",)))
RISK_WORDS = ("legacy", "deprecated", "performance", "security")
# Path segments that name no business domain.
NO_DOMAIN = (
    "src", "main", "test", "java", "kotlin", "internal", "pkg", "cmd", "api", "proto", "resources", "webapp", "node_modules", "vendor", "gen", "generated",
    "third_party", "lib", "project", "app", "module", "packages", "com", "org", "net", "io", "cn",
    "cache", "mq", "queue", "retry", "transaction", "async", "schedule", "batch", "rpc", "grpc", "http", "rest", "event", "stream", "socket", "ws",
    "common", "util", "utils", "helper", "helpers", "base", "core", "support", "shared", "misc", "tool", "tools",
)


def domain_tag(path: Column) -> Column:
    """The path segment nearest to the file that may name a business domain: no dot, two characters, none of the known words."""
    known = F.array(*[F.lit(w) for w in (*NO_DOMAIN, *(n for names in LAYER_SEGMENTS.values() for n in names))])
    fits = F.filter(
        F.split(slashes(path), "/"),
        lambda s: (F.octet_length(s) > 1) & ~F.contains(s, F.lit(".")) & ~F.array_contains(known, F.lower(s)),
    )
    return F.try_element_at(fits, F.lit(-1))


def domain_tags(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(class_id, tag): the business domain of current classes; those without one have no row."""
    rows = classes.join(files.select(F.col("id").alias("file_id"), "absolute_path"), "file_id")
    return rows.select(F.col("id").alias("class_id"), domain_tag(F.col("absolute_path")).alias("tag")).where("tag is not null")


def all_class_tags(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(class_id, tag) of current classes: the derived ones and the business domain."""
    return class_tags(classes, files).unionByName(domain_tags(classes, files)).distinct()


def layer_tag(path: Column, class_name: Column) -> Column:
    """The first path segment that names a layer, else the ending of the class name."""
    pairs = [(s, layer) for layer, names in LAYER_SEGMENTS.items() for s in names]
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    segments = F.split(F.lower(slashes(F.regexp_replace(path, r"[^/\\]*$", ""))), "/")
    by_path = F.try_element_at(F.filter(F.transform(segments, lambda s: lookup[s]), lambda t: t.isNotNull()), F.lit(1))
    by_name = F.lit(None).cast("string")
    for layer, endings in LAYER_ENDINGS.items():
        for ending in endings:
            by_name = F.when(class_name.endswith(ending), layer).otherwise(by_name)
    return F.coalesce(by_path, by_name)


def tech_tag(name: Column, method: bool = False) -> Column:
    low, out = F.lower(name), F.lit(None).cast("string")
    for tag, words in reversed(TECH_WORDS):
        if method and tag == "mq":
            words = (*words, "send")
        hit = F.lit(False)
        for word in words:
            hit |= F.contains(low, F.lit(word))
        out = F.when(hit, tag).otherwise(out)
    return out


def doc_risk_tag(doc: Column) -> Column:
    return F.when(F.upper(doc).rlike("TODO|FIXME|HACK"), "todo").when(F.contains(F.upper(doc), F.lit("DEPRECATED")), "deprecated")


def class_risk_tag(name: Column, doc: Column) -> Column:
    out = doc_risk_tag(doc)
    for word in reversed(RISK_WORDS):
        out = F.when(F.contains(F.lower(name), F.lit(word)), word).otherwise(out)
    return out


def class_test_tag(path: Column, name: Column) -> Column:
    low = F.lower(slashes(path))
    unit = low.rlike(r"(_test\.go|_test\.py|\.test\.ts|_spec\.rb|_spec\.ex)$") | low.rlike(r"/(test|tests|testdata|__tests__|spec)/")
    return F.when(unit, "unit").when(F.contains(low, F.lit("/integration/")), "integration").when(name.rlike(r"^(Test|Mock)|(Test|Mock)$"), "mock")


def method_test_tag(name: Column) -> Column:
    return F.when(name.rlike(r"^([Tt]est|[Ss]hould|[Aa]ssert|[Mm]ock)"), "mock")


def class_tags(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(class_id, tag) of current classes: layer, tech, risk, test and language."""
    rows = classes.join(files.select(F.col("id").alias("file_id"), "absolute_path", "language"), "file_id", "left")
    tags = F.array(
        layer_tag(F.col("absolute_path"), F.col("name")), tech_tag(F.col("name")), class_risk_tag(F.col("name"), F.col("doc_comment")),
        class_test_tag(F.col("absolute_path"), F.col("name")), F.nullif("language", F.lit("")),
    )
    return rows.select(F.col("id").alias("class_id"), F.explode(F.array_distinct(F.array_compact(tags))).alias("tag"))


def method_tags(methods: DataFrame) -> DataFrame:
    """(method_id, tag): tech, risk and test."""
    tags = F.array(tech_tag(F.col("name"), method=True), doc_risk_tag(F.col("doc_comment")), method_test_tag(F.col("name")))
    return methods.select(F.col("id").alias("method_id"), F.explode(F.array_distinct(F.array_compact(tags))).alias("tag"))
