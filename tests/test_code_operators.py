import pytest
from pyspark.sql import functions as F

from codeloom.operators import context, graph, imports, metrics, store, tags, testlinks


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_call_edges(spark, rows):
    calls = spark.createDataFrame([("a", "b"), ("a ", " b"), (None, "b"), ("a", ""), ("c", "c")], "caller_fqn string, callee_fqn string")
    e = graph.call_edges(calls)
    assert rows(e) == [("a", "b"), ("c", "c")]
    assert rows(graph.degrees(e), "node", "n_out", "n_in") == [("a", 1, 0), ("b", 0, 1), ("c", 1, 1)]
    assert rows(graph.orphans(e)) == [("a",)]
    assert rows(graph.hot_nodes(e, 1)) == [("b", 1)]
    assert rows(graph.adjacency(e))[0] == ("a", ["b"], [])
    assert graph.graph_size(e).first() == (3, 2)


def test_k_hop(spark, rows):
    e = edges(spark, ("A", "X"), ("B", "X"), ("C", "Y"), ("Y", "X"), ("X", "A"))
    assert rows(graph.k_hop(e, nodes(spark, "X"), 1)) == [("A", 1), ("B", 1), ("Y", 1)]
    assert rows(graph.k_hop(e, nodes(spark, "X"), 5)) == [("A", 1), ("B", 1), ("C", 2), ("Y", 1)]
    assert rows(graph.k_hop(e, nodes(spark, "nobody"), 3)) == []
    tests = spark.createDataFrame([("C", "T.c")], "method string, test_method string")
    assert ("C", 2, ["T.c"]) in rows(graph.impact(e, "X", 2, tests))


def test_shortest_path(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"))
    steps = lambda x, y: [r["node"] for r in graph.shortest_path(e, x, y).orderBy("step").collect()]
    assert steps("a", "c") == ["a", "b", "c"] and steps("a", "a") == ["a"] and steps("a", "zz") == []


def test_import_resolution(spark, rows):
    paths = ["/p/service.go", "/p/repo.go", "/j/src/main/java/com/example/service/UserService.java", "/j/com/example/service/Other.java", "C:\\w\\app\\controller\\UserController.java"]
    index = imports.suffix_index(spark.createDataFrame([(p,) for p in paths], "absolute_path string"))
    names = ["p/service", "mod/p/repo", "com.example.service.UserService", "com.example.service.*", ":app:controller:UserController", "nonexistent/pkg", "java.util.List", None, " "]
    got = {}
    for r in imports.resolve_imports(spark.createDataFrame([(n,) for n in names], "import string"), index, "mod").collect():
        got.setdefault(r["import"], set()).add(r["path"])
    assert got["p/service"] == {paths[0]} and got["mod/p/repo"] == {paths[1]} and got["com.example.service.UserService"] == {paths[2]}
    assert got["com.example.service.*"] == {paths[2], paths[3]} and got[":app:controller:UserController"] == {paths[4]}
    assert "nonexistent/pkg" not in got and "java.util.List" not in got


def test_file_graph(spark, rows):
    files = spark.createDataFrame([("/project/service.go", ["project/repo", "project/handler"]), ("/project/repo.go", ["project/base"]), ("/project/handler.go", ["project/service"]), ("/project/base.go", None)], "absolute_path string, imports array<string>")
    assert len(rows(imports.file_graph(files))) == 4


@pytest.mark.parametrize(("a", "b", "c", "d", "hit"), [(1, 10, 5, 15, True), (1, 10, 11, 20, False), (5, 3, 1, 10, False), (5, 5, 5, 5, True)])
def test_overlaps(spark, a, b, c, d, hit):
    assert spark.range(1).select(store.overlaps(*map(F.lit, (a, b, c, d)))).first()[0] is hit


def test_upserts(spark, rows):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C"), (None, "N")], "id int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "N")}
    versions = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "id int, t int, v string")
    assert rows(store.upsert_latest(versions, ["id"], "t"), "id", "v") == [(1, "c"), (2, "d")]
    children = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "owner int, v string")
    assert rows(store.replace_by_owner(children, children.where("v = 'x'"), "owner")) == [(1, "x"), (2, "z")]
    assert rows(store.replace_by_owner(children, children.limit(0), "owner", spark.createDataFrame([(2,)], "owner int"))) == [(1, "x"), (1, "y")]


def test_entity_diff(spark, rows):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "name string, start_line int, end_line int")
    new = spark.createDataFrame([("b", 3, 9), ("c", 7, 9), ("d", 1, 2)], "name string, start_line int, end_line int")
    assert rows(store.entity_diff(old, new)) == [("a", "DELETE"), ("b", "UPDATE"), ("c", "RELOCATE"), ("d", "INSERT")]


def test_tag_search(spark, rows):
    links = spark.createDataFrame([("A", "service"), ("A", "cache"), ("B", "service"), ("C", "cache")], "owner string, tag string")
    assert rows(store.tags_and(links, "owner", ["service", "service"])) == [("A",), ("B",)]
    assert rows(store.tags_and(links, "owner", ["service", "cache"])) == [("A",)]
    assert rows(store.tags_and(links, "owner", ["service", "mq"])) == []
    with pytest.raises(ValueError):
        store.tags_and(links, "owner", [])
    assert rows(store.tag_counts(links)) == [("layer", 1, 2), ("tech", 1, 2)]


def test_tag_rules(spark, rows):
    files = spark.createDataFrame([(1, "/x/controller/a.go", "go"), (2, "/x/repo/b_test.go", "go")], "id int, absolute_path string, language string")
    classes = spark.createDataFrame([(1, 1, "LegacyBatch", "todo: x"), (2, 2, "OrderRepository", None), (3, None, "Plain", None)], "id int, file_id int, name string, doc_comment string")
    assert rows(tags.class_tags(classes, files)) == [(1, "batch"), (1, "controller"), (1, "go"), (1, "legacy"), (2, "dao"), (2, "go"), (2, "unit")]


def link_table(spark):
    return spark.createDataFrame([
        ("com.OrderService", "OrderService", None, "com.OrderService.getOrder", "getOrder", None, "/s/a.go", []),
        ("com.OrderServiceTest", "OrderServiceTest", None, "com.OrderServiceTest.testGetOrder", "testGetOrder", None, "/s/b.go", []),
        ("com.OrderServiceSpec", "OrderServiceSpec", "@TestFor(OrderService.class)", "com.OrderServiceSpec.should", "should", None, "/t/c.go", []),
    ], "class_fqn string, class_name string, class_doc string, method_fqn string, method_name string, method_doc string, path string, imports array<string>")


def test_test_links(spark, rows):
    t = link_table(spark)
    assert rows(testlinks.naming_links(t), "method", "test_method", "confidence") == [("com.OrderService.getOrder", "com.OrderServiceTest.testGetOrder", 70)]
    assert ("com.OrderService.getOrder", "com.OrderServiceSpec.should", 100) in rows(testlinks.explicit_links(t), "method", "test_method", "confidence")
    assert rows(testlinks.dependency_links(t), "test_method") == [("com.OrderServiceTest.testGetOrder",)]
    tag = spark.createDataFrame([("com.OrderService", "order"), ("com.OrderServiceTest", "order")], "class_fqn string, tag string")
    every = testlinks.naming_links(t).unionByName(testlinks.tag_links(t, tag)).unionByName(testlinks.dependency_links(t))
    assert {r["strategy"] for r in testlinks.gated(every).collect()} == {"naming", "same_tag", "dependency"}
    assert {r["strategy"] for r in testlinks.gated(every, 75).collect()} == {"dependency"}
    blocks = spark.createDataFrame([("a.go", 4, 5, 1), ("a.go", 9, 9, 0)], "path string, start_line int, end_line int, count int")
    methods = spark.createDataFrame([("a.go", 4, 4, "m"), ("a.go", 9, 9, "n")], "path string, start_line int, end_line int, method string")
    assert rows(testlinks.covered_methods(blocks, methods)) == [("m",)]


def test_context(spark, rows):
    s = spark.createDataFrame([("a", 5, 5, 100), ("b", 1, 3, 4), ("c", 1, 1, None)], "symbol string, start_line int, end_line int, line_count int")
    got = {r["symbol"]: (r["hit_lines"], r["token_estimate"], r["trim_reason"]) for r in context.context_windows(s, 10).collect()}
    assert got == {"a": (15, 60, "context_lines"), "b": (4, 16, "context_lines"), "c": (0, 0, "file_unreadable")}
    assert {r["trim_reason"] for r in context.context_windows(s, 0, "minimal").collect()} == {"mode_minimal"}
    lines = context.source_lines(spark.createDataFrame([(1, "x\ny\nz\n\n"), (2, None), (3, "")], "f int, t string"), "f", "t")
    assert rows(lines) == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z")]


def test_metrics(spark, rows):
    df = spark.createDataFrame([("g", float(v)) for v in range(18)] + [("h", None)], "k string, v double")
    r = metrics.index_percentiles(df, "v", ["k"]).first()
    assert (r["p50"], r["p95"], r["p99"]) == (9.0, 17.0, 17.0)
    found, wanted = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,), (4,)], "x int")
    r = metrics.precision_recall(found, wanted, ["x"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"]) == (1, 1, 2, 0.5)
    s = spark.createDataFrame([("c", "counter", "l", 1.0, 1), ("c", "counter", "l", 2.0, 2), ("g", "gauge", "l", 5.0, 2), ("g", "gauge", "l", 7.0, 1)], "name string, type string, labels string, value double, ts int")
    assert rows(metrics.counters_and_gauges(s), "name", "value") == [("c", 3.0), ("g", 5.0)]


def test_domain_of_a_path(spark, rows):
    from codeloom.operators import tags

    files = spark.createDataFrame([(1, "/project/internal/order/service.go", "go"), (2, "C:\\src\\Billing\\util\\x\\a.go", "go"), (3, None, None), (4, "/src/cache/a.py", None)], "id bigint, absolute_path string, language string")
    classes = spark.createDataFrame([(i, i, "A", None) for i in (1, 2, 3, 4, 5)], "id bigint, file_id bigint, name string, doc_comment string")
    assert rows(tags.domain_tags(classes, files)) == [(1, "order"), (2, "Billing")]
    assert (1, "go") in rows(tags.all_class_tags(classes, files)) and (1, "order") in rows(tags.all_class_tags(classes, files))


def test_upsert_of_several_batch_rows_is_defined(spark, rows):
    from codeloom.operators import store

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "id int, v string, t int")
    for order in ([(1, "c", 2), (1, "d", 1), (None, "m", 2)], [(None, "m", 2), (1, "d", 1), (1, "c", 2)]):
        assert rows(store.upsert(old, spark.createDataFrame(order, "id int, v string, t int"), ["id"]).where("id is not null")) == [(1, "d", 1), (2, "b", 1)]
    assert store.upsert(old, spark.createDataFrame([], "id int, v string, t int"), ["id"]).count() == 3
