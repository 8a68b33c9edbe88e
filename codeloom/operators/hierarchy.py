"""Parent-child links to full hierarchies: paths, depth, roots, descendants and cycles.

Plan: find connected components of the link graph, co-locate each component (many small ones
packed into one bucket) and walk it depth-first with node colours. A component with more links
than ``max_component_links`` never enters one task: it is peeled, its cyclic core is coloured
and its paths and descendants grow level by level, all with joins. Both ways give equal rows.
Back edges depend on the order of the whole walk, so a loop of any size is walked in one task for
them, over links on disk.

Defined cases: null, empty or blank names are no classes and no parents; repeated parents are
one link; parents that are no live class are no link; a class that is its own parent is a loop;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..tables import clean_name, live_rows

#: Links of a component that may be walked inside one task; what a walk yields comes out in chunks of ``CHUNK`` rows or ids.
MAX_COMPONENT_LINKS = 20_000
CHUNK = 200_000
#: Links per bucket of packed small components.
BUCKET_LINKS = 50_000


@dataclass
class Hierarchy:
    """``nodes`` (node, full_name), ``links`` (child, parent) of node ids, both checkpointed."""

    nodes: DataFrame
    links: DataFrame


def build_hierarchy(classes: DataFrame) -> Hierarchy:
    """Live classes and the distinct links between them, from raw class rows."""
    live = live_rows(classes, ["full_name", "parent_fqns"]).select(
        "id", clean_name(F.col("full_name")).alias("full_name"), "parent_fqns"
    ).where(F.col("full_name").isNotNull())
    live = checkpoint(live)
    nodes = live.groupBy("full_name").agg(F.min("id").alias("node"))
    named = (
        live.select(F.col("full_name").alias("child_name"), F.explode("parent_fqns").alias("parent_name"))
        .select("child_name", clean_name(F.col("parent_name")).alias("parent_name"))
        .where(F.col("parent_name").isNotNull())
        .distinct()
    )
    links = named.join(
        nodes.select(F.col("full_name").alias("parent_name"), F.col("node").alias("parent")), "parent_name"
    ).join(nodes.select(F.col("full_name").alias("child_name"), F.col("node").alias("child")), "child_name")
    return Hierarchy(nodes, checkpoint(links.select("child", "parent")))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h"),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 40)), F.lit(0)).alias("s"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "child", b: str = "parent") -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node id.

    Alternating large-star / small-star rounds, O(log^2 n) of them. Only the minimum of a
    neighbourhood is aggregated (map-side combine), so a node with a third of all links never
    gathers them in a task.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    pairs = checkpoint(pairs.where("u != v"))
    before: tuple | None = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        pairs = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return members.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _split(links: DataFrame, max_links: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of small components with a ``bucket``, and links of oversized ones (None: there are none)."""
    component = connected_components(links)
    tagged = links.join(component.withColumnRenamed("node", "child"), "child")
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n_links"))
    tagged = checkpoint(tagged.join(sizes, "component"))
    big, total = tagged.agg(
        F.coalesce(F.sum((F.col("n_links") > max_links).cast("long")), F.lit(0)), F.count(F.lit(1))
    ).first()
    buckets = max(1, -(-total // BUCKET_LINKS))
    small = tagged.where(F.col("n_links") <= max_links).withColumn(
        "bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))
    )
    return small, tagged.where(F.col("n_links") > max_links).select("child", "parent") if big else None


def strong_components(parents: dict[int, list[int]]) -> list[list[int]]:
    """Loops of a graph: depth-first walk with white/grey/black nodes (Tarjan's low links, no recursion).

    A link to a grey node is a back edge; only groups closed by one are returned.
    """
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    grey: set[int] = set()
    stack: list[int] = []
    found = []
    for start in parents:
        if start in order:
            continue
        work = [(start, iter(parents[start]))]
        order[start] = low[start] = len(order)
        grey.add(start)
        stack.append(start)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    above = work[-1][0]
                    low[above] = min(low[above], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        grey.discard(group[-1])
                    if len(group) > 1 or node in parents.get(node, ()):
                        found.append(group)
            elif step not in order:
                order[step] = low[step] = len(order)
                grey.add(step)
                stack.append(step)
                work.append((step, iter(parents.get(step, ()))))
            elif step in grey:
                low[node] = min(low[node], order[step])
    return found


def _adjacency(pdf: pd.DataFrame, key: str, value: str) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {}
    for k, v in zip(pdf[key].tolist(), pdf[value].tolist()):
        near.setdefault(k, []).append(v)
    return near


def _loops_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    groups = strong_components(_adjacency(pdf, "child", "parent"))
    rows = [(n, min(g)) for g in groups for n in g]
    return pd.DataFrame(rows, columns=["node", "loop"]).astype("int64")


def _peel(links: DataFrame, rounds: int = 30) -> DataFrame:
    """Drop links that cannot lie on a loop: their child has no child or their parent no parent.

    Each round removes a layer; what is left after ``rounds`` is still a superset of all loops,
    so stopping early costs time in the colouring, never a result.
    """
    before = links.count()
    for _ in range(rounds):
        inner = links.select(F.col("child").alias("n")).distinct().join(
            links.select(F.col("parent").alias("n")).distinct(), "n", "left_semi"
        )
        links = checkpoint(
            links.join(inner.withColumnRenamed("n", "child"), "child", "left_semi").join(
                inner.withColumnRenamed("n", "parent"), "parent", "left_semi"
            )
        )
        now = links.count()
        if now == before or now == 0:
            break
        before = now
    return links.select("child", "parent")


def _coloured_loops(links: DataFrame) -> DataFrame:
    """(node, loop) of an oversized cyclic core: forward colouring, backward search, repeat.

    Every node takes the smallest id that reaches it; within a colour, what also reaches that id
    is one strong component. It is removed and the rest goes on.
    """
    done: DataFrame | None = None
    left = links
    while left.limit(1).count():
        ends = left.select(F.col("child").alias("node")).union(left.select("parent")).distinct()
        colour = checkpoint(ends.select("node", F.col("node").alias("colour")))
        while True:
            pushed = left.join(colour.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "colour")
            grown = checkpoint(
                colour.unionByName(pushed).groupBy("node").agg(F.min("colour").alias("colour"))
            )
            changed = grown.join(colour.withColumnRenamed("colour", "old"), "node").where("colour != old").limit(1).count()
            colour = grown
            if not changed:
                break
        same = left.join(colour.withColumnRenamed("node", "child"), "child").join(
            colour.select(F.col("node").alias("parent"), F.col("colour").alias("c2")), "parent"
        ).where("colour = c2").select("child", "parent", "colour")
        same = checkpoint(same)
        reached = checkpoint(colour.where("node = colour"))
        frontier = reached
        while frontier.limit(1).count():
            step = same.join(frontier.select(F.col("node").alias("parent")), "parent", "left_semi").select(
                F.col("child").alias("node"), "colour"
            ).distinct()
            frontier = checkpoint(step.join(reached, "node", "left_anti"))
            reached = checkpoint(reached.unionByName(frontier))
        inside = same.join(reached.select(F.col("node").alias("child")), "child", "left_semi").join(
            reached.select(F.col("node").alias("parent")), "parent", "left_semi"
        )
        loops = inside.select(F.col("child").alias("node"), F.col("colour").alias("loop")).union(
            inside.select("parent", "colour")
        ).distinct()
        done = loops if done is None else done.unionByName(loops)
        gone = reached.select("node")
        left = checkpoint(
            left.join(gone.withColumnRenamed("node", "child"), "child", "left_anti")
            .join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti")
            .select("child", "parent")
        )
    return done if done is not None else links.select(F.col("child").alias("node"), F.col("child").alias("loop")).limit(0)


def loop_members(links: DataFrame, max_component_links: int = MAX_COMPONENT_LINKS) -> DataFrame:
    """(node, loop): every node that is its own ancestor, with an id shared by its strong component."""
    small, big = _split(links, max_component_links)
    found = small.select("bucket", "child", "parent").groupBy("bucket").applyInPandas(_loops_in_bucket, "node long, loop long")
    if big is not None:
        core, rest = _split(_peel(big), max_component_links)
        found = found.unionByName(
            core.select("bucket", "child", "parent").groupBy("bucket").applyInPandas(_loops_in_bucket, "node long, loop long")
        )
        if rest is not None:
            found = found.unionByName(_coloured_loops(rest))
    return found


def _back_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to a grey node of a depth-first walk upwards, nodes and parents in order of their ids.

    Takes the inner links of whole loops by child and parent. Parents lie in a scratch file, 8 bytes
    a link; memory holds 33 bytes a class, and as much again while they are put together.
    """
    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=scratch) as file:
        runs = []
        for batch in batches:
            runs.append(np.unique(batch.column("child").to_numpy(), return_counts=True))
            file.write(batch.column("parent").to_numpy().astype(np.int64).tobytes())
        file.flush()
        if not file.tell():
            return
        ids, sizes = (np.concatenate(x).astype(np.int64) for x in zip(*runs))
        del runs
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, last = ids[starts], np.cumsum(np.add.reduceat(sizes, starts))
        above = np.memmap(file, np.int64, "r+")
        for i in range(0, len(above), CHUNK):
            above[i : i + CHUNK] = np.searchsorted(ids, above[i : i + CHUNK])
        # Scalars come faster out of views than out of arrays. ``at``: the next link of a node; ``below``: where the walk came from.
        at, below = memoryview(np.r_[0, last[:-1]]), memoryview(np.empty(len(ids), np.int64))
        del sizes, starts
        above, last, ids = memoryview(above), memoryview(last), memoryview(ids)
        white, grey, black = 0, 1, 2
        colour = bytearray(len(ids))
        children, parents = [], []
        for top in range(len(ids)):
            if colour[top] != white:
                continue
            node, colour[top], below[top] = top, grey, -1
            while node >= 0:
                link = at[node]
                if link == last[node]:
                    colour[node] = black
                    node = below[node]
                    continue
                at[node] = link + 1
                parent = above[link]
                if colour[parent] == white:
                    colour[parent], below[parent] = grey, node
                    node = parent
                elif colour[parent] == grey:
                    children.append(ids[node])
                    parents.append(ids[parent])
                    if len(children) >= CHUNK:
                        yield _flush({"child": children, "parent": parents})
                        children, parents = [], []
        yield _flush({"child": children, "parent": parents})


def back_links(classes: DataFrame, max_component_links: int = MAX_COMPONENT_LINKS) -> DataFrame:
    """(full_name, parent, cycle_key): links that close a loop in a depth-first walk upwards; without them there is none.

    The walk is the same for loops of any size; ``max_component_links`` only says how loops are found.
    """
    h = build_hierarchy(classes)
    loops = checkpoint(loop_members(h.links, max_component_links))
    inner = h.links.join(loops.select(F.col("node").alias("child"), "loop"), "child").join(
        loops.select(F.col("node").alias("parent"), F.col("loop").alias("above")), "parent"
    ).where("loop = above").select("child", "parent", "loop")
    found = inner.repartition("loop").sortWithinPartitions("child", "parent").select("child", "parent").mapInArrow(
        _back_in_partition, "child long, parent long"
    )
    keys = loops.join(h.nodes, "node").groupBy("loop").agg(F.min("full_name").alias("cycle_key"))
    named = found.join(loops.withColumnRenamed("node", "child"), "child").join(keys, "loop")
    return named.join(h.nodes.select(F.col("node").alias("child"), "full_name"), "child").join(
        h.nodes.select(F.col("node").alias("parent"), F.col("full_name").alias("parent_name")), "parent"
    ).select("full_name", F.col("parent_name").alias("parent"), "cycle_key")


def class_loops(classes: DataFrame, max_component_links: int = MAX_COMPONENT_LINKS) -> DataFrame:
    """(full_name, cycle_key): live classes caught in a loop; the key is the loop's smallest name by code points."""
    h = build_hierarchy(classes)
    named = loop_members(h.links, max_component_links).join(h.nodes, "node")
    keys = named.groupBy("loop").agg(F.min("full_name").alias("cycle_key"))
    return named.join(keys, "loop").select("full_name", "cycle_key")


def _flush(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=pa.schema([(n, pa.list_(pa.int64()) if n == "path" else pa.int64()) for n in columns]))


def _paths_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pdf = pa.Table.from_batches(list(batches)).to_pandas()
    up = _adjacency(pdf, "child", "parent")
    down = _adjacency(pdf, "parent", "child")
    loops = set(pdf.loc[pdf.in_loop, "child"].tolist()) | set(pdf.loc[pdf.parent_in_loop, "parent"].tolist())
    nodes, paths, held = [], [], 0
    for top in down.keys() | loops:
        if top in up and top not in loops:
            continue
        # Depth first along one path at a time: what is open are the children still to be visited on it.
        path, rest = [top], [iter(down.get(top, ()))]
        nodes.append(top)
        paths.append([top])
        while rest:
            child = next(rest[-1], None)
            if child is None:
                rest.pop()
                path.pop()
            elif child not in loops:
                path.append(child)
                rest.append(iter(down.get(child, ())))
                nodes.append(child)
                paths.append(path.copy())
                held += len(path)
            if held >= CHUNK:
                yield _flush({"node": nodes, "path": paths})
                nodes, paths, held = [], [], 0
    yield _flush({"node": nodes, "path": paths})


def hierarchy_paths(classes: DataFrame, max_component_links: int = MAX_COMPONENT_LINKS) -> DataFrame:
    """One row per class and path: full_name, root, depth, path (names from the top down), top_in_loop.

    A path runs from a root, or from the first class caught in a loop that lies above (then
    ``top_in_loop``), down to the class; a class in a loop, or without links, has the path of
    itself alone at depth 0. A class reached several ways has a row for each.
    """
    h = build_hierarchy(classes)
    loops = checkpoint(loop_members(h.links, max_component_links).select("node").distinct())
    flagged = h.links.join(loops.select(F.col("node").alias("child"), F.lit(True).alias("in_loop")), "child", "left").join(
        loops.select(F.col("node").alias("parent"), F.lit(True).alias("parent_in_loop")), "parent", "left"
    ).na.fill(False, ["in_loop", "parent_in_loop"])
    flagged = checkpoint(flagged.select("child", "parent", "in_loop", "parent_in_loop"))
    small, big = _split(flagged, max_component_links)
    ids = small.select("bucket", "child", "parent", "in_loop", "parent_in_loop").groupBy("bucket").applyInArrow(
        _paths_in_bucket, "node long, path array<long>"
    )
    if big is not None:
        big = flagged.join(big, ["child", "parent"], "left_semi")
        walked = checkpoint(big.where("not in_loop").select("child", "parent"))
        tops = (
            big.select(F.col("parent").alias("node"))
            .join(walked.select(F.col("child").alias("node")), "node", "left_anti")
            .union(big.where("in_loop").select("child"))
            .distinct()
        )
        level = checkpoint(tops.select("node", F.array("node").alias("path")))
        while level.limit(1).count():
            ids = ids.unionByName(level)
            level = checkpoint(
                walked.join(level.withColumnRenamed("node", "parent"), "parent").select(
                    F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")
                )
            )
    single = h.nodes.select("node").join(
        h.links.select(F.col("child").alias("node")).union(h.links.select("parent")).distinct(), "node", "left_anti"
    )
    ids = ids.unionByName(single.select("node", F.array("node").alias("path")))
    ids = ids.withColumn("path_id", F.monotonically_increasing_id())
    ids = checkpoint(ids)
    steps = ids.select("path_id", "node", F.posexplode("path").alias("at", "step")).join(
        h.nodes.select(F.col("node").alias("step"), "full_name"), "step"
    )
    named = steps.groupBy("path_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "full_name"))), lambda x: x["full_name"]).alias("path"),
        F.min_by("step", "at").alias("top"),
    )
    tops_in_loop = loops.select(F.col("node").alias("top"), F.lit(True).alias("top_in_loop"))
    return named.join(tops_in_loop, "top", "left").select(
        F.element_at("path", -1).alias("full_name"),
        F.element_at("path", 1).alias("root"),
        (F.size("path") - 1).alias("depth"),
        "path",
        F.coalesce("top_in_loop", F.lit(False)).alias("top_in_loop"),
    )


def _descendants_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    down = _adjacency(pa.Table.from_batches(list(batches)).to_pandas(), "parent", "child")
    tops: list[int] = []
    below: list[int] = []
    for top in down:
        seen: set[int] = set()
        todo = list(down[top])
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += down.get(node, ())
        tops += [top] * len(seen)
        below += seen
        if len(tops) >= CHUNK:
            yield _flush({"node": tops, "descendant": below})
            tops, below = [], []
    yield _flush({"node": tops, "descendant": below})


def class_descendants(classes: DataFrame, max_component_links: int = MAX_COMPONENT_LINKS) -> DataFrame:
    """(full_name, descendant): each class with every class below it; a class in a loop is below itself."""
    h = build_hierarchy(classes)
    small, big = _split(h.links, max_component_links)
    pairs = small.select("bucket", "child", "parent").groupBy("bucket").applyInArrow(
        _descendants_in_bucket, "node long, descendant long"
    )
    if big is not None:
        known = new = checkpoint(big.select(F.col("parent").alias("node"), F.col("child").alias("descendant")))
        while new.limit(1).count():
            longer = new.join(
                big.select(F.col("parent").alias("descendant"), F.col("child").alias("below")), "descendant"
            ).select("node", F.col("below").alias("descendant")).distinct()
            new = checkpoint(longer.join(known, ["node", "descendant"], "left_anti"))
            known = checkpoint(known.unionByName(new))
        pairs = pairs.unionByName(known)
    return pairs.join(h.nodes, "node").select("full_name", "descendant").join(
        h.nodes.select(F.col("node").alias("descendant"), F.col("full_name").alias("below")), "descendant"
    ).select("full_name", F.col("below").alias("descendant"))
