"""Queries p1_ and p2_: hierarchies and orphan references over the code-metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, orphans
from ..tables import table


def p1_found(spark, sf_dir):
    return hierarchy.class_loops(table(spark, sf_dir, "code_class"))


def p1_paths(spark, sf_dir):
    """Every path, written with arrows from the top down."""
    return hierarchy.hierarchy_paths(table(spark, sf_dir, "code_class")).withColumn("path", F.array_join("path", " > "))


def p1_descendants(spark, sf_dir):
    return hierarchy.class_descendants(table(spark, sf_dir, "code_class"))


def p1_back_links(spark, sf_dir):
    return hierarchy.back_links(table(spark, sf_dir, "code_class"))


def _orphans(spark, sf_dir):
    return orphans.orphan_references(
        *(table(spark, sf_dir, t) for t in ("code_call", "code_class", "code_method", "external_package"))
    )


def p2_found(spark, sf_dir):
    return _orphans(spark, sf_dir).drop("month")


def p2_report(spark, sf_dir):
    return orphans.orphan_report(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_back_links, p2_found, p2_report)}

_LIVE_CLASS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn,
          min(indexed_at) OVER (PARTITION BY id) AS first_arrival FROM code_class) WHERE rn = 1 AND deleted_at IS NULL),
cls AS (SELECT id, trim(full_name) AS full_name, parent_fqns, first_arrival, indexed_at FROM cur WHERE trim(full_name) <> ''),
links AS (SELECT DISTINCT c.full_name AS child, p.full_name AS parent FROM
          (SELECT full_name, trim(unnest(parent_fqns)) AS parent FROM cls) c JOIN cls p ON c.parent = p.full_name)"""

_CLOSURE = f"""WITH RECURSIVE {_LIVE_CLASS},
up AS (SELECT child AS node, parent AS anc FROM links UNION SELECT up.node, l.parent FROM up JOIN links l ON up.anc = l.child)"""

_ORPHANS = f"""WITH {_LIVE_CLASS},
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn,
        min(indexed_at) OVER (PARTITION BY id) AS first_arrival FROM code_method) WHERE rn = 1 AND deleted_at IS NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn,
        min(indexed_at) OVER (PARTITION BY id) AS first_arrival FROM code_call) WHERE rn = 1),
ref AS (
  SELECT 'code_call' AS table_name, 'caller_fqn' AS field, id AS row_id, 'm' AS kind, trim(caller_fqn) AS target, first_arrival, indexed_at FROM k
  UNION ALL SELECT 'code_call', 'callee_fqn', id, 'm', trim(callee_fqn), first_arrival, indexed_at FROM k
  UNION ALL SELECT DISTINCT 'code_class', 'parent_fqns', id, 'c', trim(unnest(parent_fqns)), first_arrival, indexed_at FROM cur
  UNION ALL SELECT 'code_method', 'class_id', id, 'i', CAST(class_id AS VARCHAR), first_arrival, indexed_at FROM m),
ex AS (SELECT kind, target, min(first_arrival) AS since FROM (
  SELECT 'm' AS kind, trim(full_name) AS target, first_arrival FROM m UNION ALL SELECT 'c', full_name, first_arrival FROM cls
  UNION ALL SELECT 'i', CAST(id AS VARCHAR), first_arrival FROM cur) GROUP BY ALL),
orphan AS (SELECT r.table_name, r.field, r.row_id, r.target, strftime(r.indexed_at, '%Y-%m') AS month
  FROM ref r LEFT JOIN ex USING (kind, target)
  WHERE r.target <> '' AND (ex.since IS NULL OR ex.since > r.first_arrival)
    AND (r.kind = 'i' OR NOT EXISTS (SELECT 1 FROM external_package e
         WHERE r.target = trim(e.prefix) OR starts_with(r.target, trim(e.prefix) || '.'))))"""

ORACLES = {
    "p1_found": _CLOSURE + """
SELECT a.node AS full_name, min(a.anc) AS cycle_key FROM up a JOIN up b ON a.node = b.anc AND a.anc = b.node
WHERE a.node IN (SELECT node FROM up WHERE node = anc) GROUP BY a.node""",
    "p1_descendants": _CLOSURE + " SELECT anc AS full_name, node AS descendant FROM up",
    "p1_paths": f"""WITH RECURSIVE {_LIVE_CLASS},
up AS (SELECT child AS node, parent AS anc FROM links UNION SELECT up.node, l.parent FROM up JOIN links l ON up.anc = l.child),
looped AS (SELECT DISTINCT node FROM up WHERE node = anc),
walk AS (
  SELECT full_name, full_name AS root, 0 AS depth, [full_name] AS path, full_name IN (SELECT node FROM looped) AS top_in_loop FROM (SELECT DISTINCT full_name FROM cls)
  WHERE full_name IN (SELECT node FROM looped) OR full_name NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, w.root, w.depth + 1, list_append(w.path, l.child), w.top_in_loop FROM walk w JOIN links l ON l.parent = w.full_name
  WHERE l.child NOT IN (SELECT node FROM looped))
SELECT full_name, root, depth, array_to_string(path, ' > ') AS path, top_in_loop FROM walk""",
    "p2_found": _ORPHANS + " SELECT table_name, field, row_id, target FROM orphan",
    "p2_report": _ORPHANS + " SELECT table_name, field, month, count(*) AS orphans, count(DISTINCT target) AS targets FROM orphan GROUP BY ALL",
}
