"""Context of a symbol: line windows, token estimates and packages of several symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Estimated tokens of a line.
LINE_TOKENS = 4


def source_lines(texts: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line, text): lines count from 1, empty lines at the end are dropped."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\n+$", "")
    return texts.where(F.length(body) > 0).select(key, F.posexplode(F.split(body, "\n")).alias("p", "text")).select(key, (F.col("p") + 1).alias("line"), "text")


def context_windows(symbols: DataFrame, lines: int, mode: str = "full") -> DataFrame:
    """symbol, first, last, hit_lines, token_estimate, trimmed_lines, trim_reason.

    symbols: (symbol, start_line, end_line, line_count). ``minimal`` is one summary line; ``full``
    is the body widened by ``lines`` on both sides within the file; an unreadable file (null
    line_count) gives only the summary.
    """
    if mode == "minimal":
        return symbols.select(
            "symbol", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(1).alias("hit_lines"), F.lit(LINE_TOKENS).alias("token_estimate"),
            F.greatest(F.coalesce("line_count", F.lit(1)) - 1, F.lit(0)).alias("trimmed_lines"), F.lit("mode_minimal").alias("trim_reason"),
        )
    first = F.greatest(F.col("start_line") - lines, F.lit(1))
    last = F.least(F.col("end_line") + lines, F.col("line_count"))
    readable = F.col("line_count").isNotNull()
    hit = F.when(readable, F.greatest(last - first + 1, F.lit(0))).otherwise(0)
    return symbols.select(
        "symbol", F.when(readable, first).alias("first"), F.when(readable, last).alias("last"), hit.alias("hit_lines"), (hit * LINE_TOKENS).alias("token_estimate"),
        (F.when(readable & F.lit(lines > 0), F.greatest(F.col("line_count") - hit, F.lit(0))).otherwise(0)).alias("trimmed_lines"),
        F.when(~readable, "file_unreadable").when(F.lit(lines > 0), "context_lines").otherwise("full").alias("trim_reason"),
    )


def window_text(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """symbol, text of each window; windows: (symbol, file_id, first, last), lines: (file_id, line, text)."""
    inside = windows.join(lines, "file_id").where("line between first and last")
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return inside.groupBy("symbol").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def package_totals(windows: DataFrame) -> DataFrame:
    """One row: symbols, lines and tokens of a context package; no symbols are an error to the caller."""
    return windows.agg(F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("hit_lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))
