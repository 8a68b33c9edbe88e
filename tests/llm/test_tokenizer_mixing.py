"""Exact ids against the public library, round trips, and shares of mixes."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import mixing
from codeloom.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return T.BpeEncoder(open(T.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab cd'tsre12<|endofx>\n\t.é漢😀", max_size=80))
def test_ids_equal_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == library(text) and encoder.decode(ids) == text


def test_long_pretokens_and_specials(encoder, library):
    for text in ("a" * 5000, "ab" * 3000, "<|endoftext|>", " " * 3000 + "x", "=" * 4001, "é" * 2000):
        assert encoder.encode(text) == library(text)
    assert encoder.encode(None) == [] and encoder.encode("") == []


def test_encode_decode_frames(spark, rows):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "Hello world", 5), (5, "naïve 漢字\r\n", 5)], "doc_id bigint, text string, ids int")
    ids = {r["doc_id"]: r["ids"] for r in T.encode_texts(df).collect()}
    assert ids[2] == [] and ids[3] == [] and ids[1] == ids[4] == [15496, 995]
    assert T.round_trip(df).collect() == []
    assert rows(T.count_tokens(df.select("doc_id", "text")), "doc_id", "tokens")[0] == (1, 2)
    assert T.encode_texts(df.limit(0)).collect() == []


def documents(spark, per_source, words=5):
    rows = [(i * 1000 + j, s, " word" * words * (1 + j % 3)) for i, (s, n) in enumerate(per_source.items()) for j in range(n)]
    return spark.createDataFrame([*rows, (-1, "a", None), (-2, None, "x"), (-3, "a", ""), (-4, "other", "unused text")], "doc_id bigint, source string, text string")


def test_shares_and_caps(spark):
    docs = documents(spark, {"a": 300, "b": 40, "c": 200})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 3), ("c", 0.2, 2), ("gone", 0.05, 2), (None, 0.1, 1), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    mix, plan = mixing.mix_documents(docs, targets)
    got = mix.collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= caps[r["source"]] for r in got)
    shares = {r["source"]: r for r in mixing.mix_shares(mix, plan, targets).collect()}
    for source, share in {"a": 0.5 / 0.95, "b": 0.25 / 0.95, "c": 0.2 / 0.95}.items():
        assert abs(shares[source]["reached_share"] - share) < 0.02
    assert shares["gone"]["used"] == 0 and shares["b"]["most_copies"] == 3
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix_documents(docs, targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_empty_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, weight double, max_repeats int")
    none = documents(spark, {}).where("doc_id = -1")
    assert mixing.mix_documents(none, targets)[0].collect() == []
    assert mixing.mix_documents(documents(spark, {"a": 3}), targets.limit(0))[0].collect() == []


def test_inclusion_follows_size_and_totals_hold(spark):
    import numpy as np

    sizes = {i: 1 + (i * 37) % 200 for i in range(300)}
    docs = spark.createDataFrame([(i, "a", " x" * n) for i, n in sizes.items()] + [(1000 + i, "b", " y" * 50) for i in range(40)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 5)], "source string, weight double, max_repeats int")
    full = {r["source"]: r for r in mixing.mix_shares(*mixing.mix_documents(docs, targets), targets).collect()}
    assert abs(full["a"]["reached_share"] - 0.7) < 0.005 and full["a"]["most_copies"] <= 2 and full["b"]["most_copies"] <= 5
    mix, plan = mixing.mix_documents(docs, targets, total_tokens=6000)
    used = {r["source"]: r["used"] for r in mixing.mix_shares(mix, plan, targets).collect()}
    assert abs(used["a"] - 4200) <= 5 and abs(used["b"] - 1800) <= 25
    factor = {r["source"]: r["factor"] for r in plan.collect()}
    tokens = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(docs.select("doc_id", "source", "text")).collect()}
    odds = {i: min(2, factor["a"] * tokens[i] ** 0.5) for i in sizes}
    assert abs(sum(odds[i] * tokens[i] for i in sizes) - 4200) < 2
    counts = {i: 0 for i in sizes}
    for seed in range(8):
        for r in mixing.mix_documents(docs, targets, seed, total_tokens=6000)[0].where("source = 'a'").collect():
            counts[r["doc_id"]] += r["copies"]
    small, large = ([i for i in sizes if lo <= tokens[i] < hi] for lo, hi in ((1, 60), (140, 400)))
    assert np.mean([counts[i] for i in large]) > 1.3 * np.mean([counts[i] for i in small])


def test_sizes_beyond_the_cap_are_used_max_repeats_times(spark):
    sizes = spark.createDataFrame([("a", 1)] * 100 + [("a", 100)], "source string, tokens bigint")
    plan = spark.createDataFrame([("a", 1.0, 1.0, 1, 200, 190)], "source string, weight double, share double, max_repeats int, available bigint, wanted bigint")
    assert abs(mixing.size_factors(sizes, plan).first()["factor"] - 0.9) < 1e-9
