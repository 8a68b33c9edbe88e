"""Full-text, vector and hybrid search as DataFrame plans.

Queries are short and known to the driver, documents are not: a search is one scan with the
terms or the query vector as literals, ending in a distributed top-k. Ties go by document id.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

_PY_TOKEN = re.compile(r"[^\W]+(?:[.\w]*)|\.+[\w.]*")


def query_tokens(query: str) -> tuple[list[str], bool]:
    """(tokens, prefix): a trailing ``*`` asks for prefixes."""
    query = query.strip()
    prefix = query.endswith("*")
    return _PY_TOKEN.findall(query.removesuffix("*").lower()), prefix


def index_documents(df: DataFrame, key: str, content: str) -> DataFrame:
    """doc_id, content, tokens; a repeated id keeps one (its greatest content)."""
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.coalesce(content, F.lit(""))).alias("content"))
    return once.withColumn("tokens", T.tokens(F.col("content")))


def _starts(term: str):
    return lambda t: t.startswith(term)


def fts_score(content: Column, toks: Column, query: str, mode: str) -> Column:
    """Sum over matching query tokens of occurrences / log2(tokens + 1); mode exact, fuzzy or boolean (substring)."""
    terms, prefix = query_tokens(query)
    low, size = F.lower(content), F.log2(F.size(toks) + F.lit(1.0))
    score = F.lit(0.0)
    for term in terms:
        if mode == "exact":
            hit = F.array_contains(toks, term)
        elif mode == "fuzzy" and prefix:
            hit = F.exists(toks, _starts(term))
        else:
            hit = F.contains(low, F.lit(term))
        score = score + F.when((size > 0) & hit, T.occurrences(low, term) / size).otherwise(F.lit(0.0))
    return score


def fts_search(docs: DataFrame, query: str, mode: str = "fuzzy", limit: int = 20) -> DataFrame:
    """doc_id, score, snippet, source; an empty query finds nothing."""
    scored = docs.select("doc_id", fts_score(F.col("content"), F.col("tokens"), query, mode).alias("score"), T.snippet(F.col("content")).alias("snippet"))
    found = scored.where("score > 0").withColumn("source", F.lit("fts"))
    return found.orderBy(F.desc("score"), "doc_id").limit(limit) if limit > 0 else found


def boolean_search(docs: DataFrame, all_of: list[str], any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """True boolean token search (an addition): every, some, no token."""
    toks = F.col("tokens")
    hit = F.lit(True)
    for term in all_of:
        hit &= F.array_contains(toks, term.lower())
    for term in none_of:
        hit &= ~F.array_contains(toks, term.lower())
    if any_of:
        hit &= F.arrays_overlap(toks, F.array(*[F.lit(t.lower()) for t in any_of]))
    return docs.where(hit).select("doc_id")


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_weights(docs: DataFrame, df: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """doc_id, term, tf, weight = tf / length * log2((N + 1) / df); an unknown term has factor 1."""
    df = document_frequency(docs) if df is None else df
    n = docs.count() if n is None else n
    counts = docs.select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("doc_id", "length", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    factor = F.coalesce(F.log2(F.lit(n + 1.0) / F.col("df")), F.lit(1.0))
    return counts.join(df, "term", "left").select("doc_id", "term", "tf", (F.col("tf") / F.col("length") * factor).alias("weight"))


def hash_embeddings(docs: DataFrame, dim: int = 1024, df: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """doc_id, bucket, value: sparse L2-normalised hashing TF-IDF vectors; collisions add up, no tokens give no row."""
    weights = tfidf_weights(docs, df, n).withColumn("bucket", T.fnv1a_bucket(F.col("term"), dim))
    sums = weights.groupBy("doc_id", "bucket").agg(F.sum("weight").alias("value"))
    norms = sums.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return sums.join(norms, "doc_id").select(
        "doc_id", "bucket", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.col("value")).alias("value")
    )


def vector_filters(df: DataFrame, where: dict[str, str] | None = None, contains: list[str] = (), not_contains: list[str] = (), strict: bool = False) -> DataFrame:
    """Metadata equality (a missing key counts as '' unless strict) and content filters."""
    for key, value in (where or {}).items():
        at = F.col("metadata")[key] if strict else F.coalesce(F.col("metadata")[key], F.lit(""))
        df = df.where(at == value)
    for term in contains:
        df = df.where(F.contains("content", F.lit(term)))
    for term in not_contains:
        df = df.where(~F.contains("content", F.lit(term)))
    return df


def _unit(values) -> list[float]:
    size = math.sqrt(sum(float(v) ** 2 for v in values))
    return [float(v) / size if size else float(v) for v in values]


def vector_topk(df: DataFrame, query, k: int, key: str = "id", vector: str = "vector", negative=None, mode: str = "filter", threshold: float = 0.5) -> DataFrame:
    """key, similarity of the k most similar rows; k is clamped to what is there.

    negative: a vector to avoid, by ``subtract`` (query minus it, renormalised) or ``filter`` (rows
    more similar to it than the threshold are dropped).
    """
    wanted = _unit(query)
    if negative is not None and mode == "subtract":
        wanted = _unit([a - b for a, b in zip(wanted, _unit(negative))])
    scored = df.select(F.col(key), F.col(vector), V.cosine(F.col(vector), V.literal(wanted)).alias("similarity"))
    if negative is not None and mode == "filter":
        scored = scored.where(V.cosine(F.col(vector), V.literal(negative)) <= threshold)
    return scored.select(key, "similarity").orderBy(F.desc("similarity"), key).limit(max(k, 0))


def _rescaled(df: DataFrame) -> DataFrame:
    """Scores over their maximum, negatives to 0; a maximum of 0 leaves them as they are."""
    top = df.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("top"))
    score = F.when(F.col("top") == 0, F.col("score")).otherwise(F.greatest(F.col("score") / F.col("top"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(top)).withColumn("score", score).drop("top")  # one row


def rerank(fts: DataFrame, vec: DataFrame, limit: int = 20, fts_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """Fuse two result lists (symbol, kind, file, score, snippet): weighted sum of rescaled scores."""
    a = _rescaled(fts).select("symbol", F.col("kind").alias("fk"), F.col("file").alias("ff"), F.col("score").alias("fs"), F.col("snippet").alias("fn"))
    b = _rescaled(vec).select("symbol", F.col("kind").alias("vk"), F.col("file").alias("vf"), F.col("score").alias("vs"), F.col("snippet").alias("vn"))
    fused = a.join(b, "symbol", "full").select(
        "symbol",
        F.coalesce(F.nullif("vk", F.lit("")), "fk", F.lit("")).alias("kind"),
        F.coalesce(F.nullif("vf", F.lit("")), "ff", F.lit("")).alias("file"),
        (fts_weight * F.coalesce("fs", F.lit(0.0)) + vector_weight * F.coalesce("vs", F.lit(0.0))).alias("score"),
        F.coalesce("fn", "vn").alias("snippet"),
        F.lit("fused").alias("source"),
    )
    return fused.orderBy(F.desc("score"), "symbol").limit(limit) if limit > 0 else fused


def hybrid_search(fts_docs: DataFrame, vectors: DataFrame, query: str, query_vector, limit: int = 20) -> DataFrame:
    """Full-text and vector search of twice the limit each, fused; an empty query is an error."""
    if not query.strip():
        raise ValueError("empty query")
    empty = F.lit("")
    fts = fts_search(fts_docs, query, "fuzzy", 2 * limit).select(F.col("doc_id").cast("string").alias("symbol"), empty.alias("kind"), empty.alias("file"), "score", "snippet")
    vec = vector_topk(vectors, query_vector, 2 * limit).select(
        F.col("id").cast("string").alias("symbol"), empty.alias("kind"), empty.alias("file"), F.col("similarity").alias("score"), F.lit(None).cast("string").alias("snippet")
    )
    return rerank(fts, vec, limit)
