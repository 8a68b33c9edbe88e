"""File listings as a source: language, hash, line count, size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Extensions of each language.
LANGUAGES = {
    "go": ".go", "java": ".java", "py": ".py", "ts": ".ts .tsx", "js": ".js .jsx", "rust": ".rs", "cpp": ".cpp .cc .cxx .h .hpp", "c": ".c",
    "kotlin": ".kt .kts", "swift": ".swift", "php": ".php", "csharp": ".cs", "ruby": ".rb", "bash": ".sh .bash", "scala": ".scala .sc",
    "sql": ".sql", "elixir": ".ex .exs", "ocaml": ".ml .mli", "lua": ".lua", "groovy": ".groovy", "css": ".css", "toml": ".toml",
    "yaml": ".yml .yaml", "protobuf": ".proto", "html": ".html .htm", "hcl": ".tf .hcl", "svelte": ".svelte", "markdown": ".md .markdown",
    "elm": ".elm", "cue": ".cue",
}
# Directories and files that are no sources.
SKIPPED_DIRS = (".git", "node_modules", "target", "build", "vendor", ".idea", ".vscode", "__pycache__")
SKIPPED_FILES = ("store.json", "store.lock", "store.db")
MAX_BYTES, MAX_LINES = 10 << 20, 50_000


def language(path: Column) -> Column:
    """Language by extension, ``dockerfile`` by name, else ``unknown``."""
    lookup = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for ext in exts.split() for x in (ext, name)])
    return F.when(T.base_name(path) == "Dockerfile", "dockerfile").otherwise(F.coalesce(lookup[T.extension(path)], F.lit("unknown")))


def line_count(content: Column) -> Column:
    """Newlines plus one, less one after a final newline; 0 for empty text."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.length(content) == 0, 0).otherwise(breaks + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def is_source(path: Column) -> Column:
    dirs = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    return ~T.slashes(path).rlike(rf"(^|/)({dirs})/") & ~T.base_name(path).isin(*SKIPPED_FILES)


def file_rows(df: DataFrame, path: str = "path", content: str = "content", max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """absolute_path, language, content_hash, line_count, byte_size, parse_status, content; too large files are ``parse_skipped``."""
    rows = df.where(F.col(path).isNotNull() & is_source(F.col(path))).select(
        F.col(path).alias("absolute_path"), language(F.col(path)).alias("language"), F.coalesce(content, F.lit("")).alias("content")
    )
    rows = rows.withColumn("byte_size", F.octet_length("content").cast("bigint")).withColumn("line_count", line_count(F.col("content")))
    skipped = (F.col("byte_size") > max_bytes) | (F.col("line_count") > max_lines)
    return rows.select(
        "absolute_path", "language", F.when(skipped, "").otherwise(F.sha2(F.encode("content", "UTF-8"), 256)).alias("content_hash"), "line_count", "byte_size",
        F.when(skipped, "parse_skipped").otherwise("parse_ok").alias("parse_status"), "content",
    )


def read_tree(spark: SparkSession, root: str, **limits: int) -> DataFrame:
    """All source files below a directory; texts are decoded as UTF-8 with replacement."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return file_rows(raw.select("path", F.decode("content", "UTF-8").alias("content")), **limits)
