"""Hierarchies against brute force, on both ways (in a task, and by joins)."""

import datetime as dt
import random

import pytest

from codeloom.operators import hierarchy as H

SCHEMA = "id bigint, full_name string, parent_fqns array<string>, indexed_at timestamp, deleted_at timestamp, node string, component int, target string"
T0 = dt.datetime(2025, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(i, n, p, t, d, "x", 1, "y") for i, n, p, t, d in rows], SCHEMA)


def classes(spark, links, names):
    parents = {}
    for child, parent in links:
        parents.setdefault(child, []).append(parent)
    return table(spark, [(i, n, parents.get(n), T0, None) for i, n in enumerate(sorted(names))])


def closure(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = {}
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += up.get(n, ())
        out[start] = seen
    return out


def random_links(seed, n=40, m=60):
    rng = random.Random(seed)
    names = [f"c{i:02d}" for i in range(n)]
    return names, {(rng.choice(names), rng.choice(names)) for _ in range(m)}


@pytest.mark.parametrize(("seed", "bound"), [(1, 10_000), (1, 1), (2, 20)])
def test_loops_and_descendants(spark, rows, seed, bound):
    names, links = random_links(seed)
    df = classes(spark, links, names)
    up = closure(links)
    loops = {n: min(m for m in up[n] if n in up.get(m, ())) for n in up if n in up[n]}
    assert rows(H.class_loops(df, bound)) == sorted(loops.items())
    assert rows(H.class_descendants(df, bound)) == sorted((a, n) for n in up for a in up[n])


@pytest.mark.parametrize("bound", [10_000, 1])
def test_paths(spark, rows, bound):
    links = {("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", "q")}
    got = rows(H.hierarchy_paths(classes(spark, links, "abcdxyzqs"), bound), "full_name", "root", "depth", "path", "top_in_loop")
    assert got == sorted([
        ("a", "a", 0, ["a"], False), ("b", "a", 1, ["a", "b"], False), ("c", "a", 1, ["a", "c"], False), ("d", "a", 2, ["a", "b", "d"], False),
        ("d", "a", 2, ["a", "c", "d"], False), ("x", "x", 0, ["x"], True), ("y", "y", 0, ["y"], True), ("z", "x", 1, ["x", "z"], True), ("q", "q", 0, ["q"], True), ("s", "s", 0, ["s"], False),
    ])


def test_versions_and_dirt(spark, rows):
    late = T0 + dt.timedelta(days=1)
    df = table(spark, [
        (1, " a ", ["b", None, "", "  ", " b "], T0, None), (1, " a ", ["b", None, "", "  ", " b "], T0, None), (2, "b", ["a"], T0, None),
        (3, "c", ["d"], T0, None), (4, "d", ["c"], T0, None), (4, "d", ["c"], late, late), (5, None, ["a"], T0, None), (6, "  ", ["a"], T0, None),
        (7, "e", None, None, None), (None, "f", ["f"], T0, None),
    ])
    assert rows(H.class_loops(df)) == [("a", "a"), ("b", "a")]
    assert H.class_loops(table(spark, [])).collect() == []
    assert H.hierarchy_paths(table(spark, [])).collect() == []
    assert H.class_descendants(table(spark, [])).collect() == []


def test_components(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (200, 200)], "child bigint, parent bigint")
    got = dict(rows(H.connected_components(edges)))
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and got[200] == 200


@pytest.mark.parametrize("bound", [10_000, 1])
def test_back_links_open_every_loop(spark, rows, bound):
    names, links = random_links(3, 25, 45)
    loops = dict(rows(H.class_loops(classes(spark, links, names))))
    got = rows(H.back_links(classes(spark, links, names), bound))
    assert got and all((c, p) in links and loops[c] == loops[p] == key for c, p, key in got)
    left = links - {(c, p) for c, p, _ in got}
    assert not any(n in above for n, above in closure(left).items())


def walked_back_links(links):
    """Back edges of a recursive walk within each loop, names in order."""
    above = closure(links)
    same = lambda a, b: b in above.get(a, ()) and a in above.get(b, ())
    colour, back = {}, set()

    def walk(node):
        colour[node] = "grey"
        for parent in sorted(p for c, p in links if c == node and same(c, p)):
            if parent not in colour:
                walk(parent)
            elif colour[parent] == "grey":
                back.add((node, parent, min(n for n in above if same(n, node))))
        colour[node] = "black"

    for node in sorted(n for n in above if same(n, n)):
        if node not in colour:
            walk(node)
    return sorted(back)


@pytest.mark.parametrize("seed", [1, 3])
def test_back_links_do_not_depend_on_the_bound(spark, rows, seed):
    names, links = random_links(seed, 25, 45)
    df = classes(spark, links, names)
    wanted = walked_back_links(links)
    assert wanted and rows(H.back_links(df, 10_000)) == rows(H.back_links(df, 1)) == wanted


def test_back_links_of_a_ring_in_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(H, "CHUNK", 7)
    n = 5000
    links = sorted([(i, (i + 1) % n) for i in range(n)] + [(i, i - 10) for i in range(10, n, 10)])
    table = pa.table({"child": [c * 3 for c, _ in links], "parent": [p * 3 for _, p in links]})
    batches = list(H._back_in_partition(iter(table.to_batches(max_chunksize=11))))
    got = [(c // 3, p // 3) for b in batches for c, p in zip(*(x.to_pylist() for x in b.columns))]
    assert sorted(got) == sorted([(n - 1, 0)] + [(i, i - 10) for i in range(10, n, 10)])
    assert max(b.num_rows for b in batches) <= 7 and list(H._back_in_partition(iter([]))) == []


def test_long_chain_and_diamonds_come_out_in_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(H, "CHUNK", 1000)
    chain = pa.RecordBatch.from_pydict({"bucket": [0] * 1500, "child": list(range(1, 1501)), "parent": list(range(1500))})
    sizes = [b.num_rows for b in H._descendants_in_bucket(iter([chain]))]
    assert sum(sizes) == 1500 * 1501 // 2 and max(sizes) <= 1000 + 1500
    links = [(i * 3 + k, i * 3) for i in range(10) for k in (1, 2)] + [(i * 3 + 3, i * 3 + k) for i in range(10) for k in (1, 2)]
    diamonds = pa.RecordBatch.from_pydict({
        "bucket": [0] * len(links), "child": [c for c, _ in links], "parent": [p for _, p in links], "in_loop": [False] * len(links), "parent_in_loop": [False] * len(links),
    })
    batches = list(H._paths_in_bucket(iter([diamonds])))
    assert sum(b.num_rows for b in batches) == sum(2**i for i in range(11)) + sum(2 * 2**i for i in range(10)) and len(batches) > 10
