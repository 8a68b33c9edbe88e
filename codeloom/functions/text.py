"""Text expressions: tokens, snippets, term counts, code-point FNV hashing, path parts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{Nd}_.]+"


def tokens(text: Column) -> Column:
    """Maximal runs of letters, digits, underscore and dot, in lower case; null text gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))


def snippet(text: Column, size: int = 120) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def single_line(doc: Column, size: int = 60) -> Column:
    """One line of documentation: line breaks become spaces; cut by characters (the original rule counts bytes)."""
    flat = F.replace(F.replace(doc, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(F.char_length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def fnv1a_bucket(token: Column, buckets: int) -> Column:
    """64-bit FNV-1a over code points, unsigned modulo ``buckets``; 32-bit halves keep it free of overflow."""
    mask = F.lit((1 << 32) - 1)

    def step(state: Column, char: Column) -> Column:
        mixed = state.bitwiseXOR(F.ascii(char).cast("long"))
        low = mixed.bitwiseAND(mask)
        high = F.shiftrightunsigned(mixed, 32)
        # The prime is 2**40 + 435.
        product = low * 435
        new_low = product.bitwiseAND(mask)
        new_high = (high * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.shiftleft(new_high, 32).bitwiseOR(new_low)

    start = F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    state = F.aggregate(chars, start, step)
    high, low = F.shiftrightunsigned(state, 32), state.bitwiseAND(mask)
    return ((high % buckets) * ((1 << 32) % buckets) + low) % buckets


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def store_relative(path: Column) -> Column:
    """Path from ``/internal/`` on, else from ``/pkg/`` on, else unchanged."""
    whole = slashes(path)
    return F.coalesce(
        F.nullif(F.regexp_extract(whole, r"/(internal/.*)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(whole, r"/(pkg/.*)$", 1), F.lit("")),
        whole,
    )
