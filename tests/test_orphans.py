import datetime as dt

from codeloom.operators import orphans as O

T = [dt.datetime(2025, 1, d) for d in range(1, 20)]


def frames(spark, calls=(), classes=(), methods=(), external=("ext.lib",)):
    return (
        spark.createDataFrame(list(calls), "id bigint, caller_fqn string, callee_fqn string, indexed_at timestamp, kind string"),
        spark.createDataFrame(list(classes), "id bigint, full_name string, parent_fqns array<string>, indexed_at timestamp, deleted_at timestamp, since int"),
        spark.createDataFrame(list(methods), "id bigint, class_id bigint, full_name string, indexed_at timestamp, deleted_at timestamp, target string"),
        spark.createDataFrame([(p, "x") for p in external], "prefix string, ecosystem string"),
    )


def test_orphans(spark, rows):
    calls = [
        (1, "a.m", "a.gone", T[5], "k"), (1, "a.m", "a.gone", T[5], "k"), (2, "a.m", " a.m ", T[5], "k"), (3, None, "", T[5], "k"), (4, "a.late", "ext.lib.f", T[2], "k"),
        (5, "ext.library", "a.late", T[9], None), (6, "a.m", "a.old", T[5], "k"), (7, "a.dead", "a.m", None, "k"),
    ]
    classes = [(1, "A", ["B", "B", None, "ext.lib", " A "], T[1], None, 1), (2, "D", ["Z"], T[1], None, 1), (2, "D", ["Z"], T[3], T[3], 1)]
    methods = [
        (1, 1, "a.m", T[1], None, ""), (2, 9, "a.late", T[4], None, ""), (3, None, "a.old", T[1], None, ""), (3, None, "a.new", T[6], None, ""),
        (4, 2, "a.dead", T[1], None, ""), (4, 2, "a.dead", T[2], T[2], ""),
    ]
    found = O.orphan_references(*frames(spark, calls, classes, methods))
    assert rows(found, "table_name", "field", "row_id", "target") == [
        ("code_call", "callee_fqn", 1, "a.gone"), ("code_call", "callee_fqn", 6, "a.old"), ("code_call", "callee_fqn", 7, "a.m"), ("code_call", "caller_fqn", 4, "a.late"),
        ("code_call", "caller_fqn", 5, "ext.library"), ("code_call", "caller_fqn", 7, "a.dead"), ("code_class", "parent_fqns", 1, "B"), ("code_method", "class_id", 2, "9"),
    ]
    report = O.orphan_report(found)
    assert sum(r["orphans"] for r in report.collect()) == 8


def test_empty_and_no_external(spark):
    assert O.orphan_references(*frames(spark, external=())).collect() == []


def test_signed_counts_follow_deltas(spark):
    refs, found = O.references(*frames(spark, [(1, "x", "y", T[1], "k")], [], [(1, None, "x", T[0], None, "")])[:3])
    first = O.ledger(refs, found)
    state = {r["target"]: (r["refs"], r["found"]) for r in first.collect()}
    assert state == {"x": (1, 1), "y": (1, 0)}
    back = first.select("kind", "target", (-first.refs).alias("refs"), (-first.found).alias("found"), "found_since", "ref_since")
    assert {(r["refs"], r["found"]) for r in O.merge_counts(first, back).collect()} == {(0, 0)}


def test_ledger_equals_full_recompute_in_any_order(spark, rows, tmp_path):
    import random

    calls = [
        (1, "a.m", "a.gone", T[5], "k"), (1, "a.m", "a.b", T[6], "k"), (2, "a.b", "a.late", T[3], "k"), (3, "a.m", "a.m", None, "k"), (4, "x", "a.moved", T[2], "k"), (5, "a.two", "a.two", T[7], "k"),
    ]
    classes = [(1, "A", ["B"], T[1], None, 1), (1, "A", ["C"], T[4], None, 1), (2, "B", None, T[8], None, 1), (3, "C", ["A"], T[2], None, 1), (3, "C", ["A"], T[9], T[9], 1)]
    methods = [
        (1, 1, "a.m", T[1], None, ""), (2, 3, "a.late", T[5], None, ""), (3, 1, "a.moved", T[1], None, ""), (3, 1, "a.elsewhere", T[6], None, ""), (4, 7, "a.b", T[2], None, ""),
        (5, 1, "a.two", T[1], None, ""), (5, 1, "a.two", T[8], T[8], ""), (6, 1, "a.two", T[9], None, ""),
    ]
    external = frames(spark)[3]
    want = rows(O.orphan_references(*frames(spark, calls, classes, methods)))
    assert len(want) >= 5
    deliveries = [("c", r) for r in calls] + [("k", r) for r in classes] + [("m", r) for r in methods]
    for seed in (1,):
        random.Random(seed).shuffle(deliveries)
        for at in range(0, len(deliveries), 9):
            part = deliveries[at : at + 9]
            batch = frames(spark, *([r for t, r in part if t == kind] for kind in "ckm"))[:3]
            O.OrphanLedger(str(tmp_path / str(seed)), 4).apply(*batch, at)  # a new process each time
        O.OrphanLedger(str(tmp_path / str(seed)), 4).apply(*batch, at)  # and the last delivery once more
        ledger = O.OrphanLedger(str(tmp_path / str(seed)), 4)
        assert rows(ledger.orphans(spark, external)) == want
        full = O.ledger(*O.references(*frames(spark, calls, classes, methods)[:3]))
        state = ledger.store.read(spark, "counts")
        columns = ["kind", "target", "refs", "found", "cast(found_since as string)"]
        assert rows(state.selectExpr(*columns)) == rows(full.selectExpr(*columns))
        assert ledger.store.last_batch(spark) == at
