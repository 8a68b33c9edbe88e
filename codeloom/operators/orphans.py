"""References to records that do not exist, kept as signed counts per key.

Every delivered record is a change: the version it replaces takes its references and existences
back (-1 each), its own count +1. Summed per key, keys with positive references and zero existence
are the current orphans; the earliest existence also tells keys that came into being only after
the record that refers to them. Where the earliest existence of a key is taken back, that key's
existences are read again, and only its.

``orphan_references`` makes one change out of whole tables (nothing is replaced then: versions
within a change are resolved before the shuffle). ``OrphanLedger`` keeps records and counts in
buckets of a shared folder and applies further deliveries, in any order, to those they touch.

Defined cases: names are compared trimmed; null, empty and blank names refer to nothing; null
``indexed_at`` counts as earliest; repeated rows are one record; external names are no cases;
references of deleted classes and methods are not looked at; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..streaming.buckets import BucketStore
from ..tables import clean_name


def external_name(name: Column, prefixes: DataFrame, bound: int = 10_000) -> Column:
    """True where the name equals a prefix or starts with the prefix and a dot.

    The prefix table is a small one that does not grow; its size is checked against ``bound``.
    """
    rows = prefixes.select(clean_name(F.col("prefix")).alias("p")).where("p is not null").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} external prefixes")
    if not rows:
        return F.lit(False)
    known = F.array(*[F.lit(r.p) for r in sorted(rows)])
    return F.exists(known, lambda p: (name == p) | name.startswith(F.concat(p, F.lit("."))))


RECORDS = "table_name string, row_id long, version timestamp, deleted_at timestamp, name string, names array<string>, first_arrival timestamp"
COUNTS = "kind string, target string, refs long, found long, found_since timestamp, ref_since timestamp"
_EARLIEST = "0001-01-01"


def _latest(rows: DataFrame) -> DataFrame:
    """One row per record: the latest version (ties: the greatest content) and the first arrival; combined map-side."""
    packed = rows.groupBy("table_name", "row_id").agg(
        F.max(F.struct("version", "deleted_at", "name", "names")).alias("_last"), F.min("first_arrival").alias("first_arrival")
    )
    return packed.select("table_name", "row_id", "_last.*", "first_arrival")


def records(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """The records of raw rows, one each: names are what it refers to, name is what it brings into being."""

    def rows(df: DataFrame, table: str, name: Column, names: Column, deleted: Column) -> DataFrame:
        one = df.where("id is not null").select(
            F.lit(table).alias("table_name"), F.col("id").cast("long").alias("row_id"), F.col("indexed_at").alias("version"),
            deleted.cast("timestamp").alias("deleted_at"), name.cast("string").alias("name"), names.cast("array<string>").alias("names"),
            F.col("indexed_at").alias("first_arrival"),
        )
        return _latest(one)

    return (
        rows(calls, "code_call", F.lit(None), F.array("caller_fqn", "callee_fqn"), F.lit(None))
        .unionByName(rows(classes, "code_class", F.col("full_name"), F.col("parent_fqns"), F.col("deleted_at")))
        .unionByName(rows(methods, "code_method", F.col("full_name"), F.array("class_id"), F.col("deleted_at")))
    )


def reference_rows(kept: DataFrame) -> DataFrame:
    """table_name, field, row_id, kind, target, since, month of what live records refer to."""
    live = kept.where("deleted_at is null")
    call = F.col("table_name") == "code_call"
    method = F.col("table_name") == "code_method"

    def ref(field: str, kind: str, target: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), target.alias("target"))

    named = (
        F.when(call, F.array(*[ref(f, "method", clean_name(F.col("names")[i])) for i, f in enumerate(("caller_fqn", "callee_fqn"))]))
        .when(method, F.array(ref("class_id", "class_id", F.col("names")[0])))
        .otherwise(F.transform(F.array_distinct(F.transform("names", clean_name)), lambda p: ref("parent_fqns", "class", p)))
    )
    return live.select(
        "table_name", F.explode(named).alias("ref"), "row_id",
        F.coalesce("first_arrival", F.to_timestamp(F.lit(_EARLIEST))).alias("since"), F.date_format("version", "yyyy-MM").alias("month"),
    ).select("table_name", "ref.field", "row_id", "ref.kind", "ref.target", "since", "month").where("target is not null")


def existence_rows(kept: DataFrame) -> DataFrame:
    """kind, target, since of what live records bring into being."""
    name = clean_name(F.col("name"))

    def item(kind: str, target: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), target.alias("target"))

    made = F.when(F.col("table_name") == "code_class", F.array(item("class", name), item("class_id", F.col("row_id").cast("string")))).otherwise(
        F.array(item("method", name))
    )
    live = kept.where("deleted_at is null and table_name != 'code_call'")
    since = F.coalesce("first_arrival", F.to_timestamp(F.lit(_EARLIEST))).alias("since")
    return live.select(F.explode(made).alias("made"), since).select("made.*", "since").where("target is not null")


def references(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, existences) of the current records."""
    kept = records(calls, classes, methods)
    return reference_rows(kept), existence_rows(kept)


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts of both added up; times as minima (see ``changed_counts`` for retractions)."""
    return state.unionByName(deltas).groupBy("kind", "target").agg(
        F.sum("refs").alias("refs"), F.sum("found").alias("found"), F.min("found_since").alias("found_since"), F.min("ref_since").alias("ref_since")
    )


def ledger(refs: DataFrame, found: DataFrame, sign: int = 1) -> DataFrame:
    """Signed counts per key; pre-aggregated before the shuffle. Only what is added brings times."""
    none = F.lit(None).cast("timestamp")
    zero, one = F.lit(0).cast("long"), F.lit(sign).cast("long")
    since = F.col("since") if sign > 0 else none
    rows = refs.select("kind", "target", one.alias("refs"), zero.alias("found"), none.alias("found_since"), since.alias("ref_since")).unionByName(
        found.select("kind", "target", zero.alias("refs"), one.alias("found"), since.alias("found_since"), none.alias("ref_since"))
    )
    return merge_counts(rows.limit(0), rows)


def changed_counts(counts: DataFrame, before: DataFrame, after: DataFrame, existing: DataFrame) -> DataFrame:
    """New counts from old ones, the touched records ``before`` and ``after`` the change, and all that ``existing`` then.

    A key whose earliest existence was taken back gets it from ``existing`` anew. An earliest
    reference may stay too early, which only lets more keys be looked at, never fewer.
    """
    gone = existence_rows(before)
    deltas = ledger(reference_rows(before), gone, -1).unionByName(ledger(reference_rows(after), existence_rows(after)))
    new = merge_counts(counts, deltas).where("refs != 0 or found != 0")
    doubtful = gone.select("kind", "target").distinct()
    again = existing.join(doubtful, ["kind", "target"], "left_semi").groupBy("kind", "target").agg(F.min("since").alias("again"))
    marked = doubtful.withColumn("doubtful", F.lit(True)).join(again, ["kind", "target"], "left")
    return new.join(marked, ["kind", "target"], "left").withColumn(
        "found_since", F.when(F.col("doubtful"), F.col("again")).otherwise(F.col("found_since"))
    ).select(*counts.columns)


def orphans_of(kept: DataFrame, counts: DataFrame, external: DataFrame) -> DataFrame:
    """Each orphan reference of the records: table_name, field, row_id, target, month."""
    open_keys = (
        counts.where("refs > 0 and (found = 0 or found_since > ref_since)")
        .where(~((F.col("kind") != "class_id") & external_name(F.col("target"), external)))
        .select("kind", "target", "found_since")
    )
    # The key side is unique per (kind, target); a hot key on the row side is split by the AQE skew join.
    return (
        reference_rows(kept).join(open_keys, ["kind", "target"])
        .where(F.col("found_since").isNull() | (F.col("found_since") > F.col("since")))
        .select("table_name", "field", "row_id", "target", "month")
    )


def orphan_references(calls: DataFrame, classes: DataFrame, methods: DataFrame, external: DataFrame) -> DataFrame:
    """Each orphan reference: table_name, field, row_id, target, month; whole tables as one change of an empty ledger."""
    kept = checkpoint(records(calls, classes, methods))
    return orphans_of(kept, ledger(reference_rows(kept), existence_rows(kept)), external)


class OrphanLedger:
    """Records and signed counts in a shared folder; each delivery rewrites the buckets it touches, in one commit.

    A delivery applied twice, or again after a failure, changes nothing: its records are the
    stored ones then and every +1 meets a -1.
    """

    def __init__(self, path: str, buckets: int = 64):
        self.store = BucketStore(path, {"records": (RECORDS, ["table_name", "row_id"]), "counts": (COUNTS, ["kind", "target"])}, buckets)

    def apply(self, calls: DataFrame, classes: DataFrame, methods: DataFrame, batch: int | None = None) -> None:
        spark, store = calls.sparkSession, self.store
        came = checkpoint(records(calls, classes, methods))
        touched = store.touched("records", came)
        if not touched:
            return
        stored = store.read(spark, "records", touched)
        before = checkpoint(stored.join(came.select("table_name", "row_id"), ["table_name", "row_id"], "left_semi").select(*stored.columns))
        merged = checkpoint(_latest(stored.unionByName(came)))
        after = merged.join(came.select("table_name", "row_id"), ["table_name", "row_id"], "left_semi").select(*stored.columns)
        keys = checkpoint(ledger(reference_rows(before), existence_rows(before)).unionByName(ledger(reference_rows(after), existence_rows(after))).select("kind", "target").distinct())
        held = store.touched("counts", keys)
        # The other buckets of the records are as they were: with the merged ones they are all records.
        rest = store.read(spark, "records").where(~store.bucket("records").isin(touched))
        counts = changed_counts(store.read(spark, "counts", held), before, after, existence_rows(merged.unionByName(rest)))
        store.replace(spark, {"records": (merged, touched), "counts": (counts, held)}, batch)

    def orphans(self, spark, external: DataFrame) -> DataFrame:
        return orphans_of(self.store.read(spark, "records"), self.store.read(spark, "counts"), external)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field and month of indexed_at (null month: never indexed)."""
    return orphans.groupBy("table_name", "field", "month").agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("target").alias("targets")
    )
