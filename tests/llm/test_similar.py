"""Graph search against brute force."""

import numpy as np
import pytest

from codeloom.llm import queries, similar, vamana

SCHEMA = "id string, vector array<float>, similarity int"


def clustered(seed=0, clusters=60, each=5, dim=16, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    points = np.repeat(centres, each, 0) / np.linalg.norm(np.repeat(centres, each, 0), axis=1)[:, None]
    return (points + noise * rng.normal(size=points.shape)).astype(np.float32)


def frame(spark, vectors, extra=()):
    return spark.createDataFrame([(f"v{i:04d}", [float(x) for x in v], 1) for i, v in enumerate(vectors)] + list(extra), SCHEMA)


def true_pairs(vectors, k, least):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    table = unit.astype(np.float64) @ unit.T.astype(np.float64)
    np.fill_diagonal(table, -2)
    out = set()
    for i, row in enumerate(table):
        for s, j in sorted((-s, j) for j, s in enumerate(row))[:k]:
            if -s >= least:
                out.add((f"v{min(i, j):04d}", f"v{max(i, j):04d}"))
    return out


def test_pairs_against_brute_force(spark):
    vectors = clustered()
    vectors[7] *= 30
    extra = [("null", None, 1), ("short", [1.0, 2.0], 1), ("zero", [0.0] * 16, 1), ("zero2", [0.0] * 16, 1), (None, [1.0] * 16, 1), ("v0000", [float(x) for x in vectors[0]], 1), ("nan", [float("nan")] * 16, 1)]
    got = {tuple(r) for r in similar.similar_pairs(frame(spark, vectors, extra), 5, 0.9, 16).collect()}
    want = true_pairs(vectors, 5, 0.9)
    assert len(want) > 100 and not got - want and len(got & want) >= 0.98 * len(want)


def test_exact_copies_are_not_expanded(spark):
    base = np.eye(16, dtype=np.float32)[0]
    vectors = [base] * 40
    links = similar.similar_vectors(frame(spark, vectors), 5, 0.9, 16).collect()
    per = {}
    for r in links:
        per.setdefault(r["id"], []).append(r["other"])
    assert len(per) == 40 and all(len(v) == 5 for v in per.values())
    assert sorted(per["v0020"]) == [f"v{i:04d}" for i in range(5)] and sorted(per["v0002"]) == ["v0000", "v0001", "v0003", "v0004", "v0005"]


def test_empty(spark):
    assert similar.similar_pairs(frame(spark, []), dim=16).collect() == []
    assert similar.similar_pairs(frame(spark, [np.ones(16)]), dim=16).collect() == []


def test_search_recall(spark):
    vectors = clustered(3, 100, 5)
    df = frame(spark, vectors)
    found = similar.search_index(similar.build_index(df, 16, 200), df.where("id like '%0'"), 5, 16)
    ids = [f"v{i:04d}" for i in range(len(vectors))]
    want = {i: {x for x, _ in similar.brute_force(vectors, ids, vectors[int(i[1:])][None], 6)[0]} - {i} for i in ids[::10]}
    hits = sum(r["other"] in want[r["id"]] for r in found.collect())
    assert hits >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 700])
def test_graph_of_any_size(n):
    units = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1)[:, None]
    graph = vamana.Graph(units)
    assert graph.links.shape == (n, vamana.DEGREE) and graph.links.max() < n and (graph.links != np.arange(n)[:, None]).all()
    a, b = similar._graph_pairs(units, 6)
    assert (a < b).all() and b.max(initial=0) < n


def test_graph_computes_similarities_only_to_nodes_it_meets():
    units = np.random.default_rng(1).normal(size=(16_000, 24)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1)[:, None]
    small, large = vamana.Graph(units[:4000]), vamana.Graph(units)
    for graph in (small, large):
        graph.neighbours(5)
    assert large.evaluations < 0.3 * 16_000**2 and large.evaluations < 8.5 * small.evaluations  # 4 ** 1.5 = 8, all pairs: 16


def met_pairs(units, k=5):
    met = set(zip(*(x.tolist() for x in similar._graph_pairs(units, k))))
    return met | {(b, a) for a, b in met}


def test_near_pairs_of_a_shard_meet():
    units = clustered(5, 40, 5)
    units /= np.linalg.norm(units, axis=1)[:, None]
    met = met_pairs(units)
    wanted = [(i, j) for i in range(200) for j in range(i + 1, 200) if units[i] @ units[j] > 0.9]
    assert sum(p in met for p in wanted) >= 0.95 * len(wanted)


def test_factors_of_two_are_copies_and_k_is_free(spark):
    base = np.random.default_rng(3).normal(size=16).astype(np.float32)
    links = similar.similar_vectors(frame(spark, [base * 2.0 ** (i % 7 - 3) for i in range(40)]), 9, 0.9, 16).collect()
    per = {}
    for r in links:
        per.setdefault(r["id"], []).append(r["other"])
    assert len(per) == 40 and all(len(v) == 9 for v in per.values()) and sorted(per["v0030"]) == [f"v{i:04d}" for i in range(9)]
    index = similar.build_index(frame(spark, [base]), 16)
    with pytest.raises(ValueError):
        similar.search_index(index, frame(spark, [base]), 9, 16)


def test_pivot_tree_meets_the_nearest():
    rng = np.random.default_rng(2)
    pivots = similar._unit(np.repeat(rng.normal(size=(60, 16)), 20, 0) + 0.4 * rng.normal(size=(1200, 16)))
    pivots = pivots[rng.permutation(1200)]
    rows, found, _ = similar.PivotTree(pivots).ranked(pivots[:200] + np.float32(0.01))
    first = np.searchsorted(rows, np.arange(200))
    best = np.argmax((pivots[:200] + np.float32(0.01)) @ pivots.T, axis=1)
    assert (found[first] == best).mean() >= 0.98 and len(rows) < 0.5 * 200 * 1200


def dense_cloud(n, rest, dim=96, cosine=0.95, seed=4):
    """n distinct vectors of that cosine to each other, and ``rest`` lone ones."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    points = np.sqrt(cosine) * centre / np.linalg.norm(centre) + np.sqrt((1 - cosine) / dim) * rng.normal(size=(n, dim))
    return np.concatenate([points, rng.normal(size=(rest, dim))]).astype(np.float32)


def test_dense_cloud_of_a_third_of_the_rows(spark):
    vectors = dense_cloud(2000, 4000)
    got = {tuple(r) for r in similar.similar_vectors(frame(spark, vectors), 5, 0.92, shard=40).select("id", "other").collect()}
    unit = similar._unit(vectors[:2000])
    table = unit @ unit.T
    np.fill_diagonal(table, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(table) for j in np.argsort(-row)[:5]}
    assert len(got & want) >= 0.97 * len(want)


def test_all_neighbours_of_lone_vectors(spark, tmp_path):
    vectors = np.random.default_rng(8).normal(size=(3000, 96)).astype(np.float32)
    frame(spark, vectors).select("id", "vector").write.parquet(str(tmp_path / "search_vector.parquet"))
    assert queries.QUERIES["p3_neighbours"](spark, str(tmp_path)).count() == 5 * 3000
    got = {tuple(r) for r in similar.similar_vectors(frame(spark, vectors), 5, shard=40).select("id", "other").collect()}
    unit = similar._unit(vectors)
    table = unit @ unit.T
    np.fill_diagonal(table, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(table) for j in np.argsort(-row)[:5]}
    assert len(got & want) >= 0.95 * len(want)


def test_nearest_of_a_small_shard_meet():
    units = clustered(5, 20, 5)
    units /= np.linalg.norm(units, axis=1)[:, None]
    units = units[np.random.default_rng(2).permutation(len(units))]
    met = met_pairs(units)
    table = units @ units.T
    np.fill_diagonal(table, -2)
    assert all((i, int(j)) in met for i, row in enumerate(table) for j in np.argsort(-row)[:4])
