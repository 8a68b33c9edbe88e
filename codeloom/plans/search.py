"""Search queries over documents and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import search as S
from ..tables import table


def _docs(spark, d):
    return S.index_documents(table(spark, d, "documents"), "doc_id", "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_of(spark, d, vec_id):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _fts(query, mode):
    def run(spark, d):
        return S.fts_search(_docs(spark, d), query, mode, 20).select("doc_id", F.round("score", 6).alias("score"), "snippet")

    return run


def tokenize_stats(spark, d):
    return _docs(spark, d).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def doc_frequency(spark, d):
    return S.document_frequency(_docs(spark, d))


def tfidf_weights(spark, d):
    return S.tfidf_weights(_docs(spark, d)).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def hash_embed_buckets(spark, d):
    terms = _docs(spark, d).select(F.explode("tokens").alias("term")).distinct()
    return terms.select("term", *[T.fnv1a_bucket(F.col("term"), n).alias(f"b{n}") for n in (128, 384, 1024)])


def hash_embeddings(spark, d):
    return S.hash_embeddings(_docs(spark, d), 128).select("doc_id", "bucket", F.round("value", 6).alias("value"))


def fts_boolean(spark, d):
    return S.boolean_search(_docs(spark, d), ["the"], ["search", "index"], ["vector"])


def cosine_topk(spark, d):
    return S.vector_topk(_vectors(spark, d), _vector_of(spark, d, 0), 10).select("id", F.round("similarity", 6).alias("similarity"))


def vec_where_filter(spark, d):
    rows = _vectors(spark, d).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return S.vector_topk(S.vector_filters(rows, {"label": "3"}), _vector_of(spark, d, 0), 10).select("id", F.round("similarity", 6).alias("similarity"))


def _content(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return _vectors(spark, d).join(docs, "id")


def vec_doc_contains(spark, d):
    rows = S.vector_filters(_content(spark, d), contains=["the"])
    return S.vector_topk(rows, _vector_of(spark, d, 0), 10).select("id", F.round("similarity", 6).alias("similarity"))


def vec_doc_not_contains(spark, d):
    rows = S.vector_filters(_content(spark, d), not_contains=["the"])
    return S.vector_topk(rows, _vector_of(spark, d, 0), 10).select("id", F.round("similarity", 6).alias("similarity"))


def vec_negative_filter(spark, d):
    return S.vector_topk(_vectors(spark, d), _vector_of(spark, d, 0), 10, negative=_vector_of(spark, d, 1), mode="filter", threshold=0.05).select(
        "id", F.round("similarity", 6).alias("similarity")
    )


def vec_negative_subtract(spark, d):
    return S.vector_topk(_vectors(spark, d), _vector_of(spark, d, 0), 10, negative=_vector_of(spark, d, 1), mode="subtract").select(
        "id", F.round("similarity", 6).alias("similarity")
    )


def vec_norms(spark, d):
    return _vectors(spark, d).select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"), V.is_normalised(F.col("vector")).alias("unit"))


def hybrid_search(spark, d):
    return S.hybrid_search(_docs(spark, d), _vectors(spark, d), "index scan", _vector_of(spark, d, 7), 20).select(
        "symbol", F.round("score", 6).alias("score"), "source"
    )


QUERIES = {
    "fts_exact": _fts("parents", "exact"),
    "fts_fuzzy": _fts("regist", "fuzzy"),
    "fts_prefix": _fts("Chan*", "fuzzy"),
    "fts_multi_term_score": _fts("index the the file", "fuzzy"),
    **{f.__name__: f for f in (
        tokenize_stats, doc_frequency, tfidf_weights, hash_embed_buckets, hash_embeddings, fts_boolean, cosine_topk, vec_where_filter,
        vec_doc_contains, vec_doc_not_contains, vec_negative_filter, vec_negative_subtract, vec_norms, hybrid_search,
    )},
}

_D = """WITH d AS (SELECT doc_id, content, regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}_.]+') AS tokens
  FROM (SELECT doc_id, max(coalesce(text, '')) AS content FROM documents GROUP BY doc_id))"""


def _sql_score(terms, mode):
    parts = []
    for t in terms:
        hit = {"exact": f"list_contains(tokens, '{t}')", "prefix": f"len(list_filter(tokens, lambda x: starts_with(x, '{t}'))) > 0"}.get(
            mode, f"contains(lower(content), '{t}')"
        )
        parts.append(f"CASE WHEN {hit} AND len(tokens) > 0 THEN (length(lower(content)) - length(replace(lower(content), '{t}', ''))) / {len(t)}.0 / log2(len(tokens) + 1) ELSE 0 END")
    return " + ".join(parts)


def _sql_fts(terms, mode):
    return f"""{_D}, s AS (SELECT doc_id, {_sql_score(terms, mode)} AS score, content FROM d)
SELECT doc_id, round(score, 6) AS score, CASE WHEN length(content) > 120 THEN left(content, 120) || '...' ELSE content END AS snippet
FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20)"""


_TFIDF = _D + """, c AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM c GROUP BY ALL), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM c GROUP BY term),
w AS (SELECT doc_id, term, tf, tf / n * log2(((SELECT count(*) FROM d) + 1) / df) AS weight FROM tf JOIN df USING (term))"""
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(term, ''), lambda x: ord(x)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_VEC = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0), n AS (SELECT vector AS nv FROM v WHERE id = 1)"


def _sql_top(source, where="true", score="list_cosine_similarity(vector, qv)"):
    return f"""{_VEC} SELECT id, round(similarity, 6) AS similarity FROM (SELECT id, {score} AS similarity FROM {source}, q, n WHERE {where} ORDER BY similarity DESC, id LIMIT 10)"""


ORACLES = {
    "fts_exact": _sql_fts(["parents"], "exact"),
    "fts_fuzzy": _sql_fts(["regist"], "fuzzy"),
    "fts_prefix": _sql_fts(["chan"], "prefix"),
    "fts_multi_term_score": _sql_fts(["index", "the", "the", "file"], "fuzzy"),
    "tokenize_stats": _D + " SELECT doc_id, len(tokens)::INT AS n_tokens, len(list_distinct(tokens))::INT AS n_distinct FROM d",
    "doc_frequency": _D + " SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY term",
    "tfidf_weights": _TFIDF + " SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w",
    "hash_embed_buckets": _D + f" SELECT term, ({_FNV} % 128)::BIGINT AS b128, ({_FNV} % 384)::BIGINT AS b384, ({_FNV} % 1024)::BIGINT AS b1024 FROM (SELECT DISTINCT unnest(tokens) AS term FROM d)",
    "hash_embeddings": _TFIDF + f""", s AS (SELECT doc_id, ({_FNV} % 128)::BIGINT AS bucket, sum(weight) AS value FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM s""",
    "fts_boolean": _D + " SELECT doc_id FROM d WHERE list_contains(tokens, 'the') AND list_has_any(tokens, ['search', 'index']) AND NOT list_contains(tokens, 'vector')",
    "cosine_topk": _sql_top("v"),
    "vec_where_filter": _sql_top("v", "label = 3"),
    "vec_doc_contains": _sql_top("v JOIN documents ON doc_id = id", "contains(text, 'the')"),
    "vec_doc_not_contains": _sql_top("v JOIN documents ON doc_id = id", "NOT contains(text, 'the')"),
    "vec_negative_filter": _sql_top("v", "list_cosine_similarity(vector, nv) <= 0.05"),
    "vec_negative_subtract": _sql_top("v", score="list_cosine_similarity(vector, list_transform(list_zip(list_transform(qv, lambda x: x / sqrt(list_inner_product(qv, qv))), list_transform(nv, lambda x: x / sqrt(list_inner_product(nv, nv)))), lambda p: p[1] - p[2]))"),
    "vec_norms": _VEC + " SELECT id, round(sqrt(list_inner_product(vector, vector)), 6) AS norm, abs(sqrt(list_inner_product(vector, vector)) - 1) < 1e-6 AS unit FROM v",
    "hybrid_search": _D + f""", s AS (SELECT doc_id, {_sql_score(["index", "scan"], "fuzzy")} AS score FROM d),
f AS (SELECT doc_id, score / max(score) OVER () AS fs FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)),
e AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS sim FROM embeddings ORDER BY sim DESC, id LIMIT 40),
g AS (SELECT id, greatest(sim / max(sim) OVER (), 0) AS vs FROM e)
SELECT symbol, round(score, 6) AS score, 'fused' AS source FROM (SELECT CAST(coalesce(doc_id, id) AS VARCHAR) AS symbol, 0.3 * coalesce(fs, 0) + 0.7 * coalesce(vs, 0) AS score
FROM f FULL JOIN g ON doc_id = id ORDER BY score DESC, symbol LIMIT 20)""",
}
