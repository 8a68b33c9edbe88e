"""Imports resolved to files: a suffix index of paths and ranked equi-joins, the first strategy that hits wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Extensions that a path loses in the index.
STRIPPED = (".go", ".java", ".ts", ".py", ".rs", ".cpp", ".h")
# Packages of the Java platform and common frameworks, never resolved to files.
JAVA_PLATFORM = (
    "java.", "javax.", "jdk.", "sun.", "oracle.", "org.junit.", "org.mockito.", "org.hamcrest.", "org.slf4j.", "org.apache.logging.",
    "org.apache.log4j.", "org.springframework.", "org.springframework.boot.", "com.fasterxml.", "com.google.common.", "com.google.gson.",
    "io.netty.", "org.apache.commons.", "lombok.",
)
SOURCE_ROOTS = ("src/main/java", "src/main/kotlin", "src/test/java", "src/test/kotlin")


def suffix_index(files: DataFrame) -> DataFrame:
    """(key, path): every suffix of the path by segments, known extensions stripped, and the base name without extension."""
    parts = F.split(T.slashes(F.col("absolute_path")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    stripped = F.transform(suffixes, lambda s: F.regexp_replace(s, r"(?:" + "|".join(e.replace(".", r"\.") for e in STRIPPED) + r")+$", ""))
    base = T.base_name(F.col("absolute_path"))
    keys = F.concat(stripped, F.array(F.regexp_replace(base, r"\.[^.]*$", "")))
    return files.where("absolute_path is not null").select(F.col("absolute_path").alias("path"), F.explode(F.array_distinct(keys)).alias("key")).where(
        "key != '' and not endswith(key, '/')"
    ).select("key", "path").distinct()


def candidate_keys(imp: Column, go_module: str = "", roots: Sequence[str] = SOURCE_ROOTS) -> Column:
    """Keys to try for an import, in order; null entries are strategies that do not apply."""
    dotted = F.replace(imp, F.lit("."), F.lit("/"))
    last = lambda c: F.substring_index(c, "/", -1)
    platform = F.lit(False)
    for prefix in JAVA_PLATFORM:
        platform |= imp.startswith(prefix)
    keys: list[Column] = []
    if go_module:
        inside = F.when(imp.startswith(f"{go_module}/"), F.substring(imp, len(go_module) + 2, 1 << 20))
        keys += [inside, last(inside)]
    java = F.when(~platform & ~imp.startswith(":") & ~imp.endswith(".*"), dotted)
    keys.append(java)
    for root in roots:
        keys += [F.concat(F.lit(f"{root}/"), java), F.concat(F.lit(f"{root}/"), last(java))]
    module = F.when(imp.startswith(":"), F.replace(F.substring(imp, 2, 1 << 20), F.lit(":"), F.lit("/")))
    first, rest = F.substring_index(module, "/", 1), F.regexp_replace(module, r"^[^/]*/?", "")
    keys.append(module)
    keys += [F.concat(first, F.lit(f"/{root}/"), rest) for root in roots]
    keys += [F.concat(F.lit(f"{root}/"), module) for root in roots]
    keys.append(last(module))
    for root in roots:
        keys += [F.concat(F.lit(f"{root}/"), last(module)), F.concat(first, F.lit(f"/{root}/"), last(module))]
    plain = F.when(~imp.startswith(":") & ~imp.endswith("*"), imp)
    plain_dotted = F.when(~imp.startswith(":") & ~imp.endswith("*") & imp.contains("."), dotted)
    keys += [plain, last(plain), plain_dotted, last(plain_dotted)]
    return F.array(*keys)


def resolve_imports(imports: DataFrame, index: DataFrame, go_module: str = "") -> DataFrame:
    """(import, path, strategy): all files of the first key that is in the index; wildcards match files below the package.

    imports: (import); each distinct import is resolved once.
    """
    names = imports.select(F.trim("import").alias("import")).where("import != ''").distinct()
    tried = names.select("import", F.posexplode(candidate_keys(F.col("import"), go_module)).alias("strategy", "key")).where("key is not null and key != ''")
    hits = tried.join(index, "key")
    first = W.partitionBy("import")
    exact = hits.withColumn("best", F.min("strategy").over(first)).where("strategy = best").select("import", "path", "strategy").distinct()
    package = F.regexp_replace(F.replace(F.replace(F.regexp_replace("import", r"^:", ""), F.lit(":"), F.lit("/")), F.lit("."), F.lit("/")), r"/\*$", "")
    wild = names.where("endswith(import, '.*') or endswith(import, ':*')").select("import", package.alias("folder"))
    # A file lies below every prefix of its key, so the prefix match is an equi-join.
    parts = F.split("key", "/")
    below = index.select("path", parts.alias("parts")).select(
        "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("folder"), F.array_join("parts", "/").alias("key")
    ).where("folder != key").select("folder", "path").distinct()
    return exact.unionByName(wild.join(below, "folder").select("import", "path", F.lit(-1).alias("strategy")).distinct())


def file_graph(files: DataFrame, go_module: str = "") -> DataFrame:
    """Distinct (src, dst) of files: src imports dst."""
    uses = files.select(F.col("absolute_path").alias("src"), F.explode("imports").alias("import")).withColumn("import", F.trim("import"))
    found = resolve_imports(uses, suffix_index(files), go_module)
    return uses.join(found, "import").select("src", F.col("path").alias("dst")).where("src != dst").distinct()
