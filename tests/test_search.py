import math

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import search as S


def docs(spark, texts):
    return S.index_documents(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), "doc_id", "text")


def test_fts_modes(spark):
    d = docs(spark, {"u": "class UserService { user user }", "o": "OrderService order.user", "n": None, "e": ""})
    ids = lambda q, m="fuzzy": [r["doc_id"] for r in S.fts_search(d, q, m).collect()]
    assert ids("userservice", "exact") == ["u"]
    assert ids("user") == ["u", "o"]
    assert ids("Order*") == ["o"]
    assert ids("") == [] and ids("***") == [] and ids("nothing") == []
    assert S.boolean_search(d, ["class"], none_of=["order"]).collect()[0][0] == "u"


def test_fts_score_counts_repeats(spark):
    d = docs(spark, {"a": "aa aa b"})
    once = S.fts_search(d, "aa").first()["score"]
    assert math.isclose(once, 2 / math.log2(4)) and math.isclose(S.fts_search(d, "aa aa").first()["score"], 2 * once)


def test_tfidf_and_embedding(spark):
    d = docs(spark, {"a": "x x y", "b": "x z"})
    w = {(r["doc_id"], r["term"]): r["weight"] for r in S.tfidf_weights(d).collect()}
    assert math.isclose(w["a", "x"], 2 / 3 * math.log2(3 / 2)) and math.isclose(w["b", "z"], 1 / 2 * math.log2(3))
    norms = S.hash_embeddings(d, 64).groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0) for r in norms)
    unknown = S.tfidf_weights(d, S.document_frequency(docs(spark, {"c": "q"})), 1).collect()
    assert {round(r["weight"], 6) for r in unknown if r["term"] == "y"} == {round(1 / 3, 6)}


def test_fnv_matches_integers(spark):
    words = ["a", "foobar", "größe", "漢字", "😀x", "_"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", T.fnv1a_bucket(F.col("w"), 384).alias("b")).collect():
        h = 14695981039346656037
        for c in r["w"]:
            h = ((h ^ ord(c)) * 1099511628211) % 2**64
        assert r["b"] == h % 384


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "x"), (2, [0.0, 0.0], "y"), (3, [1.0], "z"), (4, None, None), (5, [4.0, 3.0], "x")], "id int, vector array<float>, content string")
    got = {r["id"]: r["c"] for r in df.select("id", V.cosine(F.col("vector"), V.literal([3, 4])).alias("c")).collect()}
    assert math.isclose(got[1], 1.0) and got[2] == 0 and got[3] == 0 and math.isclose(got[5], 0.96)
    assert [r["id"] for r in S.vector_topk(df, [3, 4], 2).collect()] == [1, 5]
    assert S.vector_topk(df, [3, 4], 0).collect() == []
    kept = S.vector_topk(df.where("id in (1, 5)"), [3, 4], 9, negative=[3, 4], threshold=0.97).collect()
    assert [r["id"] for r in kept] == [5]
    meta = df.withColumn("metadata", F.create_map(F.lit("k"), "content"))
    assert {r["id"] for r in S.vector_filters(meta, {"k": "x"}, contains=["x"], not_contains=["q"]).collect()} == {1, 5}
    assert {r["id"] for r in S.vector_filters(meta, {"other": ""}).collect()} == {1, 2, 3, 4, 5}
    assert S.vector_filters(meta, {"other": ""}, strict=True).collect() == []


def results(spark, rows):
    return spark.createDataFrame([(s, "", "", x, None) for s, x in rows], "symbol string, kind string, file string, score double, snippet string")


def test_rerank(spark):
    fused = S.rerank(results(spark, [("a", 1.0), ("b", 0.5)]), results(spark, [("b", 1.0), ("c", 0.8)]), 10, 0.5, 0.5)
    assert [(r["symbol"], round(r["score"], 6)) for r in fused.collect()] == [("b", 0.75), ("a", 0.5), ("c", 0.4)]
    assert S.rerank(results(spark, []), results(spark, [])).collect() == []
    negative = S.rerank(results(spark, []), results(spark, [("a", -0.5)]), 10).collect()
    assert negative[0]["score"] == -0.35
    assert len(S.rerank(results(spark, [("a", 1.0), ("b", 1.0), ("c", 1.0)]), results(spark, []), 2).collect()) == 2


def test_hybrid_needs_a_query(spark):
    with pytest.raises(ValueError):
        S.hybrid_search(docs(spark, {"a": "x"}), None, " ", [1.0])
