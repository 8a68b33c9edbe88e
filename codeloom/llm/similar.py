"""The most similar vectors of every vector: sharded robust-pruned graphs.

Pivots drawn from the data (a bounded, documented sample) cut the space into shards that follow
its density. Every vector is stored in the shard of its nearest pivot and is a query in further
near shards. Each shard builds a pruned directed graph and walks it with a beam for its own
vectors and for the queries; similarities are computed only to nodes that a walk meets. A pair
found by either side counts for both; candidates are checked exactly and the best of all shards
are kept.

A vector with many pivots near it lies in a dense cloud, where its neighbours are spread over
many shards: it is a query in as many as grow with the root of the number of near pivots.

Vectors that are equal but for a power of two as a factor are one node with its k + 1 smallest
ids (no more can be among the k best of anything), further ones are linked to the smallest ids
of their group; so no group, however large, meets in one task.

Defined cases: null vectors, vectors of another length, with null or non-finite values or all
zero are invalid and have no rows; null ids too; a repeated id counts once; ties in similarity go
by id; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vamana

#: Vectors stored in a shard, shards in which a vector is searched at least, pivots at most.
SHARD, COPIES, MAX_PIVOTS = 1000, 3, 100_000
#: Shards searched for each vector, times the root of the number of pivots near it.
PROBES = 5.0
#: Beam of a search and links of a node, and those where the nearest hardly stand out: in a dense cloud, and however far they may be.
BEAM, WIDE_BEAM, WIDE_DEGREE = 16, 64, 24


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of the valid vectors, their values as float32)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    rows = np.nonzero(lengths == dim)[0]
    if not rows.size:
        return rows, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.fill_null(float("nan")), dtype=np.float32).reshape(-1, dim)
    fine = np.isfinite(values).all(1) & (values != 0).any(1)
    return rows[fine], values[fine]


def _scaled(values: np.ndarray) -> np.ndarray:
    """The values with their greatest between a half and one by a power of two, which is exact; no negative zeros."""
    return np.ldexp(values, -np.frexp(np.abs(values).max(1, initial=0))[1][:, None]) + np.float32(0)


def _unit(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1)[:, None]).astype(np.float32)


def valid_vectors(vectors: DataFrame, dim: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Rows with an id and a vector of the wanted length, all values finite, one at least not zero."""
    most, least = F.array_max("vector"), F.array_min("vector")  # NaN counts as greatest
    return vectors.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(
        F.col("id").isNotNull() & (F.size(F.array_compact("vector")) == dim) & (F.size("vector") == dim)
        & (most < F.lit(float("inf"))) & (least > F.lit(float("-inf"))) & ((most != 0) | (least != 0))
    )


def draw_pivots(valid: DataFrame, dim: int, shard: int = SHARD, max_pivots: int = MAX_PIVOTS) -> np.ndarray:
    """Unit vectors of a hash-drawn sample, one for about ``shard`` rows, at most ``max_pivots`` (under 40 MB)."""
    rows = valid.count()
    wanted = min(max_pivots, max(1, math.ceil(rows / shard)))
    chance = min(1.0, (1.2 * wanted + 30) / max(1, rows))
    drawn = valid.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000_000)) < F.lit(int(1e9 * chance) + 1))
    sample = drawn.limit(2 * wanted + 200).toArrow()
    if rows and not sample.num_rows:
        sample = valid.limit(1).toArrow()
    _, values = _matrix(sample.column("vector"), dim)
    if not len(values):
        return np.empty((0, dim), np.float32)
    distinct = np.unique(_unit(values), axis=0)
    return np.random.default_rng(11).permutation(distinct)[:wanted]


class PivotTree:
    """Pivots under a coarser level of about their root: a vector meets the pivots below its nearest ``PARENTS`` only."""

    PARENTS, FLAT = 12, 400

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.tops = None
        if len(pivots) > self.FLAT:
            self.tops = pivots[: math.ceil(math.sqrt(len(pivots)))]  # pivots are in random order
            parent = np.concatenate([np.argmax(pivots[at : at + 10_000] @ self.tops.T, axis=1) for at in range(0, len(pivots), 10_000)])
            self.below = [np.nonzero(parent == t)[0].astype(np.int32) for t in range(len(self.tops))]

    def ranked(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, similarity) of all pivots met, by row and then falling similarity; a few thousand rows at a time."""
        if self.tops is None:
            near = units @ self.pivots.T
            order = np.argsort(-near, axis=1, kind="stable")
            return np.repeat(np.arange(len(units)), near.shape[1]), order.ravel(), np.take_along_axis(near, order, 1).ravel()
        parents = min(self.PARENTS, len(self.tops))
        top = np.argpartition(-(units @ self.tops.T), parents - 1, axis=1)[:, :parents]
        order = np.argsort(top, axis=None, kind="stable")
        who, ends = order // parents, np.searchsorted(top.ravel()[order], np.arange(len(self.tops) + 1))
        rows, pivots, sims = [], [], []
        for t, below in enumerate(self.below):
            some = who[ends[t] : ends[t + 1]]
            if some.size and below.size:
                rows.append(np.repeat(some, below.size))
                pivots.append(np.tile(below, some.size))
                sims.append((units[some] @ self.pivots[below].T).ravel())
        rows, pivots, sims = np.concatenate(rows), np.concatenate(pivots), np.concatenate(sims)
        order = np.lexsort((-sims, rows))
        return rows[order], pivots[order], sims[order]


def _near_floor(least: float | None) -> float:
    """Similarity of a pivot that may be wanted by a vector that is itself wanted: twice the angle."""
    return -2.0 if least is None else 2 * least * least - 1 if least > 0 else -2.0


def _shards(units: np.ndarray, tree: PivotTree, copies: int, floor: float | None, probes: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, shards, whether the row is only searched there); with ``copies`` 1 and no ``floor`` its own shard alone."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 2_000_000 // max(1, len(tree.pivots) if tree.tops is None else 12 * len(tree.tops)))
    for at in range(0, len(units), step):
        rows, shards, sims = tree.ranked(units[at : at + step])
        first = np.searchsorted(rows, np.arange(len(units[at : at + step]) + 1))
        rank = np.arange(len(rows)) - first[rows]
        wanted = np.full(len(first) - 1, copies)
        if floor is not None:
            wanted = np.maximum(wanted, np.ceil(probes * np.sqrt(np.bincount(rows[sims >= floor], minlength=len(wanted)))).astype(int))
        kept = rank < wanted[rows]
        out.append((at + rows[kept], shards[kept], rank[kept] > 0))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, bool))


_ROUTED = "shard int, ids array<string>, vector binary, probe boolean"
#: Routed rows in one batch, as a vector of a dense cloud has many.
ROUTED_ROWS = 20_000


def route(valid: DataFrame, pivots: np.ndarray, dim: int, copies: int, keep: int | None, floor: float | None = None, probes: float = PROBES, labels: np.ndarray | None = None) -> DataFrame:
    """shard, ids (the ``keep`` smallest of the copies in a batch, None: all), vector (float32 bytes), probe (not stored, only searched)."""
    shared = valid.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS of them, under 40 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = PivotTree(shared.value)
        for batch in batches:
            rows, values = _matrix(batch.column("vector"), dim)
            if not rows.size:
                continue
            ids = batch.column("id").take(pa.array(rows)).to_pylist()
            values = _scaled(values)
            groups: dict[bytes, list[str]] = {}
            first: list[int] = []
            for i, (id_, raw) in enumerate(zip(ids, map(bytes, values))):
                if raw in groups:
                    groups[raw].append(id_)
                else:
                    groups[raw] = [id_]
                    first.append(i)
            if not len(shared.value):
                continue
            rows, shards, probe = _shards(_unit(values[first]), tree, copies, floor, probes)
            if labels is not None:
                shards = labels[shards]
            smallest = [sorted(set(g))[:keep] for g in groups.values()]
            raws = list(groups)
            for at in range(0, len(rows), ROUTED_ROWS):
                part = rows[at : at + ROUTED_ROWS].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shards[at : at + ROUTED_ROWS].astype(np.int32)),
                        pa.array([smallest[r] for r in part], pa.list_(pa.string())),
                        pa.array([raws[r] for r in part], pa.binary()),
                        pa.array(probe[at : at + ROUTED_ROWS]),
                    ],
                    names=["shard", "ids", "vector", "probe"],
                )

    return valid.mapInArrow(run, _ROUTED)


def _nodes(table: pa.Table, dim: int, keep: int) -> tuple[list[list[str]], np.ndarray]:
    """Distinct vectors of a shard: (smallest ids of each, values)."""
    merged: dict[bytes, list[str]] = {}
    for ids, raw in zip(table.column("ids").to_pylist(), table.column("vector").to_pylist()):
        merged[raw] = sorted({*merged[raw], *ids})[:keep] if raw in merged else ids
    order = sorted(merged)
    values = np.frombuffer(b"".join(order), np.float32).reshape(-1, dim) if order else np.empty((0, dim), np.float32)
    return [merged[raw] for raw in order], values


def _graph_pairs(units: np.ndarray, k: int, width: int = BEAM, probes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that a walk through the graph of ``units`` met; ``probes`` are numbered after them."""
    n = len(units)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    graph = vamana.Graph(units, degree=vamana.DEGREE if width == BEAM else WIDE_DEGREE)
    found = [graph.neighbours(k, width)[0]]
    if probes is not None and len(probes):
        found.append(graph.search(probes, k, width)[0])
    near = [f.ravel() for f in found]
    rows = np.concatenate([np.repeat(np.arange(len(f)) + at, f.shape[1]) for f, at in zip(found, (0, n))])
    nodes = np.concatenate(near).astype(np.int64)
    rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
    total = n + (len(probes) if probes is not None else 0)
    code = np.unique(np.minimum(rows, nodes) * total + np.maximum(rows, nodes))
    return code // total, code % total


_LINKS = "id string, other string, similarity double"


def _shard_links(k: int, least: float | None, dim: int):
    def run(table: pa.Table) -> pa.Table:
        probe = table.column("probe")
        ids, values = _nodes(table.filter(pa.compute.invert(probe)), dim, k + 1)
        extra_ids, extra = _nodes(table.filter(probe), dim, k + 1)
        stored = len(ids)
        ids, wide = ids + extra_ids, np.concatenate([values, extra]).astype(np.float64)
        wide /= np.linalg.norm(wide, axis=1)[:, None] if len(wide) else 1.0
        units = wide.astype(np.float32)
        # Many vectors searched for each stored one tell of a dense cloud, where the nearest hardly stand out.
        width = WIDE_BEAM if least is None or len(extra) > 2 * COPIES * stored else BEAM
        a, b = _graph_pairs(units[:stored], k + 1, width, units[stored:])
        exact = np.einsum("ij,ij->i", wide[a], wide[b])
        if least is not None:
            a, b, exact = a[exact >= least], b[exact >= least], exact[exact >= least]
        source, target, sims = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([exact, exact])
        order = np.lexsort((target, -sims, source))
        source, target, sims = source[order], target[order], sims[order]
        out: tuple[list[str], list[str], list[float]] = ([], [], [])
        ends = np.searchsorted(source, np.arange(len(ids) + 1))
        for node in range(len(ids)):
            own = ids[node]
            if ends[node] == ends[node + 1] and (node >= stored or len(own) == 1):
                continue  # a probe's own copies are linked elsewhere
            near = [(1.0, o) for o in own]
            for t in range(ends[node], ends[node + 1]):
                if len(near) > k + len(own) and sims[t] < near[k + len(own) - 1][0]:
                    break
                near += [(float(sims[t]), o) for o in ids[target[t]]]
            near.sort(key=lambda x: (-x[0], x[1]))
            for id_ in own:
                for sim, other in [x for x in near[: k + 1] if x[1] != id_][:k]:
                    out[0].append(id_)
                    out[1].append(other)
                    out[2].append(sim)
        return pa.table({"id": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()), "similarity": pa.array(out[2], pa.float64())})

    return run


def copy_links(valid: DataFrame, k: int) -> DataFrame:
    """Links inside groups of copies: every id with the k smallest others of its group."""
    greatest = F.greatest(F.array_max("vector"), -F.array_min("vector")).cast("double")
    scaled = F.transform("vector", lambda x: x.cast("double") / F.pow(F.lit(2.0), F.floor(F.log2(greatest))) + F.lit(0.0))
    keyed = valid.select("id", scaled.alias("v")).select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    sizes = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(sizes, ["h1", "h2"])
    salted = W.partitionBy("h1", "h2", "salt").orderBy("id")
    whole = W.partitionBy("h1", "h2").orderBy("id")
    few = (
        members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
        .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
        .select("h1", "h2", F.col("id").alias("other"), "r")
    )
    inside = few.select("h1", "h2", F.col("other").alias("id"), F.col("r").alias("own"))
    pairs = members.join(few, ["h1", "h2"]).join(inside, ["h1", "h2", "id"], "left")
    wanted = F.when(F.col("own").isNull(), F.col("r") <= k).otherwise((F.col("r") <= k + 1) & (F.col("id") != F.col("other")))
    return pairs.where(wanted).select("id", "other", F.lit(1.0).alias("similarity"))


def similar_vectors(
    vectors: DataFrame, k: int = 5, least: float | None = None, dim: int = 96, shard: int = SHARD, copies: int = COPIES
) -> DataFrame:
    """id, other, similarity: the k most similar other ids of every valid id (above ``least``)."""
    valid = valid_vectors(vectors, dim)
    pivots = draw_pivots(valid, dim, shard)
    links = route(valid, pivots, dim, copies, k + 1, _near_floor(least)).groupBy("shard").applyInArrow(_shard_links(k, least, dim), _LINKS)
    all_links = links.unionByName(copy_links(valid, k)).groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "other")  # few rows per id: k per shard and copy list
    return all_links.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.92, dim: int = 96) -> DataFrame:
    """id_a, id_b: unordered pairs of similar_vectors, the smaller id first."""
    links = similar_vectors(vectors, k, least, dim)
    return links.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# ------------------------------------------------------------------ index and search

_INDEX = "shard int, node int, ids array<string>, vector binary, links binary, entry boolean, centre binary, keep int"


def _index_shard(dim: int, keep: int, shared):
    def run(table: pa.Table) -> pa.Table:
        ids, values = _nodes(table, dim, keep)
        graph = vamana.Graph(_unit(values), degree=WIDE_DEGREE)
        entry = np.zeros(len(ids), bool)
        entry[graph.entries] = True
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "shard": pa.array([shard] * len(ids), pa.int32()),
            "node": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": pa.array(ids, pa.list_(pa.string())),
            "vector": pa.array(list(map(bytes, values)), pa.binary()), "links": pa.array(list(map(bytes, graph.links)), pa.binary()), "entry": pa.array(entry),
            "centre": pa.array([bytes(shared.value[shard]) if not i else None for i in range(len(ids))], pa.binary()),
            "keep": pa.array([keep] * len(ids), pa.int32()),
        })

    return run


def build_index(vectors: DataFrame, dim: int = 96, shard: int = SHARD, keep: int = 6) -> DataFrame:
    """The graph of every shard as a table: shard, node, ids (the ``keep`` smallest of copies), vector, links, entry, centre, keep.

    Each vector lies in one shard; ``centre`` is the shard's pivot, on its first node.
    """
    valid = valid_vectors(vectors, dim)
    pivots = draw_pivots(valid, dim, shard)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    return route(valid, pivots, dim, 1, keep).groupBy("shard").applyInArrow(_index_shard(dim, keep, shared), _INDEX)


def _search_shard(k: int, width: int, dim: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        a: list[str] = []
        b: list[str] = []
        s: list[float] = []
        if index.num_rows and queries.num_rows:
            index = index.sort_by("node")
            vectors = _unit(np.frombuffer(b"".join(index.column("vector").to_pylist()), np.float32).reshape(-1, dim))
            links = np.frombuffer(b"".join(index.column("links").to_pylist()), np.int32).reshape(len(vectors), -1)
            entries = np.nonzero(np.asarray(index.column("entry")))[0].astype(np.int32)
            ids = index.column("ids").to_pylist()
            units = _unit(np.frombuffer(b"".join(queries.column("vector").to_pylist()), np.float32).reshape(-1, dim))
            found, sims = vamana.Graph(vectors, links, entries, links.shape[1]).search(units, k + 1, width)
            for own, row, score in zip(queries.column("ids").to_pylist(), found, sims):
                for name in own:
                    near = [(-float(x), o) for n, x in zip(row, score) if n >= 0 for o in ids[n] if o != name]
                    for x, o in sorted(near)[:k]:
                        a.append(name)
                        b.append(o)
                        s.append(-x)
        return pa.table({"id": pa.array(a, pa.string()), "other": pa.array(b, pa.string()), "similarity": pa.array(s, pa.float64())})

    return run


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, dim: int = 96, width: int = WIDE_BEAM, probes: float = PROBES) -> DataFrame:
    """id, other, similarity: the k best of the index for each query (id, vector).

    A query goes to as many nearest shards as grow with the root of their number and is
    beam-searched in the graph of each; an index keeps ids for k up to its ``keep`` less one.
    """
    kept = index.agg(F.min("keep")).first()[0]
    if kept is not None and k >= kept:
        raise ValueError(f"the index keeps {kept} ids of copies, too few for the {k} best")
    centres = {r["shard"]: r["centre"] for r in index.where("centre is not null").select("shard", "centre").toLocalIterator()}  # at most MAX_PIVOTS
    labels = np.array(sorted(centres), np.int32)
    pivots = np.frombuffer(b"".join(centres[s] for s in labels.tolist()), np.float32).reshape(-1, dim)
    valid = valid_vectors(queries, dim).groupBy("id").agg(F.first("vector").alias("vector"))
    routed = route(valid, pivots, dim, 1, None, -2.0, probes, labels)  # None: every id of a copy is a query
    found = index.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_search_shard(k, width, dim), _LINKS)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def brute_force(vectors: np.ndarray, ids: list[str], queries: np.ndarray, k: int) -> list[list[tuple[str, float]]]:
    """The k best of each query by all similarities; for tests and recall measurements."""
    table = _unit(queries).astype(np.float64) @ _unit(vectors).astype(np.float64).T
    out = []
    for row in table:
        best = sorted(((-s, ids[i]) for i, s in enumerate(row)))[:k]
        out.append([(i, -s) for s, i in best])
    return out


