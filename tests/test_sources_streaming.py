import datetime as dt

import pytest

from codeloom.sources import declarations, external, files
from codeloom.streaming import changes


def test_file_rows(spark, rows):
    df = spark.createDataFrame([("/a/x.go", "a\nb\n"), ("/a/Dockerfile", ""), ("/a/vendor/y.go", "z"), ("/a/big.py", "1\n" * 9), ("/a/n.kt", None), (None, "x")], "path string, content string")
    got = {r["absolute_path"]: r for r in files.file_rows(df, max_lines=5).collect()}
    assert set(got) == {"/a/x.go", "/a/Dockerfile", "/a/big.py", "/a/n.kt"}
    assert got["/a/x.go"]["line_count"] == 2 and got["/a/x.go"]["language"] == "go" and len(got["/a/x.go"]["content_hash"]) == 64
    assert got["/a/big.py"]["parse_status"] == "parse_skipped" and got["/a/big.py"]["content_hash"] == ""
    assert got["/a/Dockerfile"]["language"] == "dockerfile" and got["/a/n.kt"]["language"] == "kotlin" and got["/a/n.kt"]["line_count"] == 0


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.go").write_text("package a\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("x")
    assert [r["language"] for r in files.read_tree(spark, str(tmp_path)).collect()] == ["go"]


SOURCES = {
    "go": ("// Doc of T\ntype T struct {\n}\nfunc (t *T) Run(x int) {\n\tt.Stop(x) // not.called()\n\ts := \"fake(1)\"\n}\n", "T", "Run", "t.Stop"),
    "java": ("/** Doc */\npublic class A {\n  public int run(int x) {\n    helper.go(x);\n  }\n}\n", "A", "run", "helper.go"),
    "py": ("class A:\n    def run(self):\n        self.stop(1)  # no(1)\n", "A", "run", "self.stop"),
    "ts": ("export class A {\n  run(x: number) {\n    stop(x);\n  }\n}\n", "A", "run", "stop"),
    "rust": ("pub struct A {\n}\nimpl A {\n    pub fn run(&self) {\n        self.stop(1);\n    }\n}\n", "A", "run", "self.stop"),
    "kotlin": ("data class A(val x: Int) {\n  fun run() {\n    stopIt(x)\n  }\n}\n", "A", "run", "stopIt"),
}


@pytest.mark.parametrize("language", SOURCES)
def test_declarations(language):
    text, klass, method, call = SOURCES[language]
    found = list(declarations.scan(text, language))
    assert any(k == "class" and n == klass for k, n, *_ in found)
    assert any(k == "method" and n == method for k, n, *_ in found)
    assert [(n, owner) for k, n, _, owner, *_ in found if k == "call" and n == call] == [(call, method)]
    assert not any("fake" in f[1] or "not" in f[1] for f in found)


def test_declarations_frame(spark):
    df = spark.createDataFrame([(1, "go", SOURCES["go"][0]), (2, "go", None), (3, "unknown", "x()"), (4, "go", "")], "file_id bigint, language string, content string")
    assert {r["file_id"] for r in declarations.declarations(df).collect()} == {1}


def test_scip(spark, rows, tmp_path):
    (tmp_path / "i.json").write_text('{"documents":[{"relative_path":"a.go","language":"go","symbols":[{"id":"s1","name":"Foo","kind":0},{"id":"s2","name":"bar","kind":1}],'
        '"occurrences":[{"symbol":"s1","symbol_role":"definition","range":[1,0,1,3]},{"symbol":"s2","symbol_role":"definition","range":[2,0,2,3]},'
        '{"symbol":"s2","symbol_role":"reference","range":[3,0,3,3]},{"symbol":"zz","symbol_role":"reference","range":[4,0,4,3]}]}]}')
    symbols, calls = external.scip_records(external.read_scip(spark, str(tmp_path / "i.json")))
    assert rows(symbols, "kind", "name") == [("class", "Foo"), ("method", "bar")]
    assert rows(calls) == [("a.go", "a.go", "bar", 3)]


def test_graph_source(spark, rows):
    nodes = spark.createDataFrame([(1, "A", "Class", "a.go", 1), (2, "m", "function", "a.go", None), (3, "", "class", "a.go", 1)], "id int, name string, kind string, file string, line int")
    edges = spark.createDataFrame([(2, 1, "calls"), (2, 9, "calls")], "source_id int, target_id int, kind string")
    classes, methods, calls = external.graph_records(nodes, edges)
    assert rows(classes, "name", "type") == [("A", "CLASS")] and rows(methods, "name", "line") == [("m", 0)] and rows(calls) == [("m", "A", "direct")]
    assert external.graph_schema(["nodes", "edges"]) == "nodes"
    with pytest.raises(ValueError):
        external.graph_schema(["edges"])
    callers = spark.createDataFrame([("p.A.m",), ("q",)], "caller string")
    symbols = spark.createDataFrame([("p.A", "/a"), ("p", "/b")], "symbol string, path string")
    assert rows(external.caller_files(callers, symbols)) == [("p.A.m", "/a")]


def test_coverage_and_history(spark, rows, tmp_path):
    lines = spark.createDataFrame([("mode: set",), ("a/b.go:4.1,5.2 1 1",), ("junk",)], "value string")
    assert rows(external.read_coverprofile(lines)) == [("a/b.go", 4, 5, 1)]
    text = spark.createDataFrame([('{"t1":["a","b"]}',), ("broken",)], "value string")
    assert rows(external.read_coverage_json(text)) == [("t1", "a"), ("t1", "b")]
    (tmp_path / "h.jsonl").write_text('# note\n{"n": 1}\n\n{"n": 2}\n')
    assert rows(external.read_history(spark, str(tmp_path / "h.jsonl"), "n int")) == [(1,), (2,)]
    adapters = spark.createDataFrame([("regex", "go", 1), ("lsp", "go", 2), ("regex", "py", 1)], "adapter string, language string, position int")
    assert rows(external.select_adapters(adapters, ["lsp"])) == [("go", "lsp"), ("py", "regex")]
    assert rows(external.select_adapters(adapters, [])) == [("go", "regex"), ("py", "regex")]
    a, b = adapters.where("adapter = 'lsp'"), adapters.where("adapter = 'regex'")
    assert len(external.with_fallback(a, b, "language").collect()) == 2


def test_debounce_batch(spark):
    t = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(milliseconds=200)), ("a", t + dt.timedelta(seconds=2)), ("b", t), (None, t)], "path string, ts timestamp")
    got = sorted((r["path"], r["changes"]) for r in changes.debounce(ev, "path", "ts").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_streaming_upsert(spark, tmp_path, rows):
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "id int, v string, t int"
    seen = []
    sink = changes.IncrementalTable(str(target), ["id"], "t", degrade_at=2, degraded=seen.append)

    def run(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run([(1, "a", 1), (2, "b", 1)])
    run([(1, "c", 2), (1, "old", 0)])
    assert rows(sink.read(spark), "id", "v") == [(1, "c"), (2, "b")]
    assert seen == [2]


def test_table_survives_a_restart_and_deletes(spark, tmp_path, rows):
    schema = "id int, v string, t int, gone boolean"

    def sink():
        return changes.IncrementalTable(str(tmp_path / "out"), ["id"], "t", deleted="gone", buckets=4)

    assert sink().read(spark) is None
    sink()(spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, False)], schema), 0)
    sink()(spark.createDataFrame([(3, "c", 1, False)], schema), 1)
    assert rows(sink().read(spark), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    sink()(spark.createDataFrame([(2, None, 3, True)], schema), 2)
    sink()(spark.createDataFrame([(2, "late", 2, False)], schema), 3)
    sink()(spark.createDataFrame([], schema), 4)
    (tmp_path / "out" / "rows" / "000000000099").mkdir()  # an attempt that died before its commit
    assert rows(sink().read(spark), "id", "v") == [(1, "a"), (3, "c")]


def test_snapshot_changes(spark, rows):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime int, size int")
    b = spark.createDataFrame([("y", 2, 1), ("z", 1, 1), ("w", 1, 1)], "path string, mtime int, size int")
    assert rows(changes.snapshot_changes(a, b)) == [("w", "new"), ("x", "deleted"), ("y", "changed")]
