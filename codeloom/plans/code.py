"""Queries of the reference operators over the code-metadata tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, graph, imports, store, tags, testlinks
from ..session import busy_partitions
from ..sources import declarations as decl
from ..sources import external, files
from ..tables import current_rows, table


def _files(spark, d):
    return current_rows(table(spark, d, "code_file"), ["absolute_path", "content_hash", "line_count", "byte_size", "referenced_by_files", "imports", "language", "parse_status"])


def _classes(spark, d):
    rows = current_rows(table(spark, d, "code_class"), ["file_id", "name", "full_name", "type", "parent_fqns", "start_line", "end_line", "doc_comment", "deleted_at"])
    return rows.where("deleted_at is null")


def _methods(spark, d):
    rows = current_rows(table(spark, d, "code_method"), ["class_id", "name", "full_name", "signature", "start_line", "end_line", "doc_comment", "deleted_at"])
    return rows.where("deleted_at is null")


def _edges(spark, d):
    return graph.call_edges(table(spark, d, "code_call"))


def _hottest(edges):
    return graph.hot_nodes(edges, 1).select("node")


def language_counts(spark, d):
    return _files(spark, d).groupBy(files.language(F.col("absolute_path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def file_measures(spark, d):
    texts = table(spark, d, "file_text").select(F.concat(F.lit("f"), "file_id", F.lit(".go")).alias("path"), "content")
    return files.file_rows(texts, max_lines=150).select("absolute_path", "language", "content_hash", "line_count", "byte_size", "parse_status")


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_size(spark, d):
    return graph.graph_size(_edges(spark, d))


def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


def orphan_methods(spark, d):
    return graph.orphans(_edges(spark, d))


def hot_methods(spark, d):
    return graph.hot_nodes(_edges(spark, d))


def direct_callers(spark, d):
    edges = _edges(spark, d)
    return edges.join(_hottest(edges).withColumnRenamed("node", "dst"), "dst", "left_semi").select("src")


def khop_callers(spark, d):
    edges = _edges(spark, d)
    return graph.k_hop(edges, _hottest(edges), 2, "callers")


def khop_callees(spark, d):
    edges = _edges(spark, d)
    start = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))
    return graph.k_hop(edges, start, 3, "callees")


def shortest_path_length(spark, d):
    edges = _edges(spark, d)
    start = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select("src").first()
    if start is None:
        return spark.createDataFrame([], "steps bigint")
    reached = graph.k_hop(edges, spark.createDataFrame([(start[0],)], "node string"), 3, "callees").orderBy(F.desc("depth"), "node").limit(1).first()
    path = graph.shortest_path(edges, start[0], reached["node"] if reached else start[0])
    return path.agg((F.count(F.lit(1)) - 1).alias("steps"))


def hierarchy_edges(spark, d):
    return graph.hierarchy_edges(_classes(spark, d))


def reverse_references(spark, d):
    return graph.reverse_references(_files(spark, d))


def file_nodes(spark, d):
    return graph.file_nodes(_files(spark, d), _classes(spark, d), _methods(spark, d))


def module_summary(spark, d):
    rows = graph.module_summary(_files(spark, d), _classes(spark, d), _methods(spark, d), _edges(spark, d))
    return rows.withColumn("languages", F.to_json("languages"))


def import_index(spark, d):
    return imports.suffix_index(_files(spark, d))


def import_resolve(spark, d):
    rows = _files(spark, d)
    uses = rows.select(F.explode("imports").alias("import"))
    return imports.resolve_imports(uses, imports.suffix_index(rows)).select("import", "path").distinct()


def file_graph(spark, d):
    return imports.file_graph(_files(spark, d))


def upsert_latest(spark, d):
    rows = table(spark, d, "code_call").select("id", "caller_fqn", "callee_fqn", "indexed_at")
    return store.upsert_latest(rows, ["id"], "indexed_at").select("id", "caller_fqn", "callee_fqn")


def replace_by_owner(spark, d):
    calls = current_rows(table(spark, d, "code_call"), ["file_id", "line_number"]).select("id", "file_id", F.coalesce("line_number", F.lit(-1)).alias("line_number"))
    batch = calls.where("file_id % 3 = 0").select("id", "file_id", (F.col("line_number") + 1).alias("line_number"))
    return store.replace_by_owner(calls, batch, "file_id")


def cascade_delete(spark, d):
    f, c, m = _files(spark, d), _classes(spark, d), _methods(spark, d)
    k = current_rows(table(spark, d, "code_call"), ["file_id"])
    ct, mt = tags.class_tags(c, f), tags.method_tags(m)
    left = store.cascade_delete(f.where("id % 4 = 1").select("id"), f, c, m, k, ct, mt)
    out = None
    for name, df in left.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def hash_gate(spark, d):
    rows = _files(spark, d).select("absolute_path", "content_hash")
    scanned = rows.withColumn("content_hash", F.when(F.length("absolute_path") % 5 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return store.changed_files(rows, scanned.distinct()).select("absolute_path").distinct()


def entity_diff(spark, d):
    rows = _classes(spark, d).select("full_name", "start_line", "end_line")
    old = rows.where("start_line % 7 != 1")
    new = rows.where("start_line % 5 != 2").select(
        "full_name", (F.col("start_line") + F.when(F.col("end_line") % 3 == 0, 1000).otherwise(0)).alias("start_line"),
        (F.col("end_line") + F.when(F.col("end_line") % 3 == 0, 1000).otherwise(0)).alias("end_line"),
    )
    return store.entity_diff(old, new, "full_name").withColumnRenamed("name", "full_name")


def class_tags(spark, d):
    return tags.class_tags(_classes(spark, d), _files(spark, d))


def domain_tags(spark, d):
    return tags.domain_tags(_classes(spark, d), _files(spark, d))


def all_class_tags(spark, d):
    return tags.all_class_tags(_classes(spark, d), _files(spark, d))


def method_tags(spark, d):
    return tags.method_tags(_methods(spark, d))


def tag_and_search(spark, d):
    return store.tags_and(class_tags(spark, d), "class_id", ["cache", "java", "java"])


def tag_counts(spark, d):
    return store.tag_counts(class_tags(spark, d))


def symbol_enrichment(spark, d):
    return store.symbol_kind(table(spark, d, "fts_entry").select("id").distinct(), _classes(spark, d), _methods(spark, d), _files(spark, d), "id")


def index_documents(spark, d):
    docs = store.index_documents(_files(spark, d), _classes(spark, d), _methods(spark, d))
    return docs.select("doc_id", F.length("content").alias("size"))


def shared_tag_links(spark, d):
    """Shared-tag links with routers standing in for test classes (the data has none)."""
    rows = testlinks.symbols(_files(spark, d), _classes(spark, d), _methods(spark, d))
    named = rows.withColumn("class_name", F.regexp_replace("class_name", "Router$", "Test"))
    risk = tags.class_tags(_classes(spark, d), _files(spark, d)).where("tag = 'cache' or tag = 'batch'")
    of_class = risk.join(_classes(spark, d).select(F.col("id").alias("class_id"), F.col("full_name").alias("class_fqn")), "class_id").select("class_fqn", "tag")
    return testlinks.tag_links(named, of_class).groupBy("method").agg(F.count(F.lit(1)).alias("tests"))


def _context(spark, d):
    sizes = _files(spark, d).select(F.col("id").alias("file_id"), "line_count")
    rows = _classes(spark, d).join(sizes, "file_id", "left").select(F.col("full_name").alias("symbol"), "start_line", "end_line", "line_count")
    return context.context_windows(rows, 10)


def context_window(spark, d):
    return _context(spark, d).na.fill(0, ["first", "last"])


def context_totals(spark, d):
    return context.package_totals(_context(spark, d))


def window_text(spark, d):
    rows = _classes(spark, d).where("start_line > 0").select(F.col("id").alias("symbol"), "file_id", F.col("start_line").alias("first"), (F.col("start_line") + 1).alias("last"))
    return context.window_text(rows, context.source_lines(table(spark, d, "file_text"), "file_id", "content"))


def doc_lines(spark, d):
    return _classes(spark, d).select("id", T.single_line(F.col("doc_comment")).alias("line"))


def nearest_class(spark, d):
    c = _classes(spark, d)
    m = _methods(spark, d).join(c.select(F.col("id").alias("class_id"), "file_id"), "class_id").select("file_id", F.col("start_line").alias("line"), F.col("full_name").alias("name"))
    return graph.nearest_class(m.where("line is not null"), c.where("start_line is not null"))


def source_declarations(spark, d):
    texts = table(spark, d, "file_text").repartition(busy_partitions(spark), "file_id").join(_files(spark, d).select(F.col("id").alias("file_id"), files.language(F.col("absolute_path")).alias("language")), "file_id")
    return decl.declarations(texts)


def caller_files(spark, d):
    c = _classes(spark, d).join(_files(spark, d).select(F.col("id").alias("file_id"), "absolute_path"), "file_id").select(F.col("full_name").alias("symbol"), F.col("absolute_path").alias("path"))
    return external.caller_files(_edges(spark, d).select(F.col("src").alias("caller")), c)


QUERIES = {
    f.__name__: f
    for f in (
        language_counts, file_measures, graph_edges, graph_size, degrees, orphan_methods, hot_methods, direct_callers, khop_callers, khop_callees, shortest_path_length,
        hierarchy_edges, reverse_references, file_nodes, module_summary, import_index, import_resolve, file_graph, upsert_latest, replace_by_owner, cascade_delete,
        hash_gate, entity_diff, class_tags, domain_tags, all_class_tags, method_tags, tag_and_search, tag_counts, symbol_enrichment, index_documents, shared_tag_links, context_window,
        context_totals, window_text, doc_lines, nearest_class, source_declarations, caller_files,
    )
}


def _cur(name: str, source: str, live: bool) -> str:
    deleted = ", deleted_at DESC NULLS LAST" if live else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST{deleted}) AS rn FROM {source})
  WHERE rn = 1{' AND deleted_at IS NULL' if live else ''})"""


_BASE = "WITH RECURSIVE " + ",\n".join([_cur("f", "code_file", False), _cur("c", "code_class", True), _cur("m", "code_method", True)])
_EDGE = _BASE + """, e AS (SELECT DISTINCT trim(caller_fqn) AS src, trim(callee_fqn) AS dst FROM code_call WHERE trim(caller_fqn) <> '' AND trim(callee_fqn) <> ''),
deg AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node),
hot AS (SELECT node FROM deg ORDER BY n_in DESC, node LIMIT 1),
busy AS (SELECT src AS node FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"""
_HOP = """, hop AS (SELECT node, 0 AS depth FROM {start} UNION SELECT e.{far}, hop.depth + 1 FROM e JOIN hop ON e.{near} = hop.node WHERE hop.depth < {n}),
least AS (SELECT node, min(depth)::INT AS depth FROM hop GROUP BY node)"""


def _case(words: dict[str, tuple], test: str) -> str:
    return " ".join(f"WHEN {test.format(w=w)} THEN '{tag}'" for tag, names in words.items() for w in names)


_TECH = {"cache": ("cache",), "mq": ("queue", "mq"), "retry": ("retry",), "transactional": ("transaction",), "async": ("async",), "schedule": ("schedule", "cron"), "batch": ("batch",)}
_DOC_RISK = "CASE WHEN regexp_matches(upper(doc_comment), 'TODO|FIXME|HACK') THEN 'todo' WHEN contains(upper(doc_comment), 'DEPRECATED') THEN 'deprecated' END"
_RISK = "CASE " + " ".join(f"WHEN contains(lower(name), '{w}') THEN '{w}'" for w in tags.RISK_WORDS) + f" ELSE {_DOC_RISK} END"
_SEGMENTS = {layer: names for layer, names in tags.LAYER_SEGMENTS.items()}
_SEG_CASE = "CASE " + " ".join(f"WHEN seg IN ({', '.join(repr(n) for n in names)}) THEN '{layer}'" for layer, names in _SEGMENTS.items()) + " END"
_END_CASE = "CASE " + " ".join(f"WHEN ends_with(name, '{e}') THEN '{layer}'" for layer, ends in reversed(tags.LAYER_ENDINGS.items()) for e in reversed(ends)) + " END"
_PATH = "replace(absolute_path, '\\', '/')"
_TAGS = _BASE + f""", cf AS (SELECT c.id, c.name, c.doc_comment, {_PATH} AS path, language FROM c LEFT JOIN f ON c.file_id = f.id),
seg AS (SELECT id, pos, {_SEG_CASE} AS layer FROM (SELECT id, unnest(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/')) AS seg,
  generate_subscripts(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), 1) AS pos FROM cf)),
lay AS (SELECT id, arg_min(layer, pos) AS layer FROM seg WHERE layer IS NOT NULL GROUP BY id),
ct AS (SELECT DISTINCT id AS class_id, tag FROM (
  SELECT id, coalesce(layer, {_END_CASE}) AS tag FROM cf LEFT JOIN lay USING (id)
  UNION ALL SELECT id, CASE {_case(_TECH, "contains(lower(name), '{w}')")} END FROM cf
  UNION ALL SELECT id, {_RISK} FROM cf
  UNION ALL SELECT id, CASE WHEN regexp_matches(lower(path), '(_test\\.go|_test\\.py|\\.test\\.ts|_spec\\.rb|_spec\\.ex)$|/(test|tests|testdata|__tests__|spec)/') THEN 'unit'
    WHEN contains(lower(path), '/integration/') THEN 'integration' WHEN regexp_matches(name, '^(Test|Mock)|(Test|Mock)$') THEN 'mock' END FROM cf
  UNION ALL SELECT id, language FROM cf) WHERE tag <> '')"""
_DOMAIN = f""", dom AS (SELECT id AS class_id, arg_max(seg, pos) AS tag FROM (SELECT id, unnest(string_split(path, '/')) AS seg,
  generate_subscripts(string_split(path, '/'), 1) AS pos FROM cf WHERE path IS NOT NULL) WHERE strlen(seg) > 1 AND NOT contains(seg, '.')
  AND lower(seg) NOT IN ({', '.join(repr(w) for w in (*tags.NO_DOMAIN, *(n for names in tags.LAYER_SEGMENTS.values() for n in names)))}) GROUP BY id)"""
_MTECH = {**_TECH, "mq": ("queue", "mq", "send")}
_MTAGS = f"""mt AS (SELECT DISTINCT id AS method_id, tag FROM (
  SELECT id, CASE {_case(_MTECH, "contains(lower(name), '{w}')")} END AS tag FROM m UNION ALL SELECT id, {_DOC_RISK} FROM m
  UNION ALL SELECT id, CASE WHEN regexp_matches(name, '^([Tt]est|[Ss]hould|[Aa]ssert|[Mm]ock)') THEN 'mock' END FROM m) WHERE tag IS NOT NULL)"""
_LANG = "CASE WHEN regexp_extract({p}, '[^/]*$') = 'Dockerfile' THEN 'dockerfile' " + " ".join(
    f"WHEN lower(regexp_extract(regexp_extract({{p}}, '[^/]*$'), '(\\.[^.]+)$', 1)) IN ({', '.join(repr(e) for e in exts.split())}) THEN '{name}'" for name, exts in files.LANGUAGES.items()
) + " ELSE 'unknown' END"
_STRIP = "(?:" + "|".join(e.replace(".", "\\.") for e in imports.STRIPPED) + ")+$"
_INDEX = _BASE + f""", parts AS (SELECT absolute_path AS path, string_split({_PATH}, '/') AS p FROM f WHERE absolute_path IS NOT NULL),
ix AS (SELECT DISTINCT key, path FROM (
  SELECT path, regexp_replace(array_to_string(p[i:], '/'), '{_STRIP}', '') AS key FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts)
  UNION ALL SELECT path, regexp_replace(p[len(p)], '\\.[^.]*$', '') FROM parts) WHERE key <> '' AND NOT ends_with(key, '/'))"""
_PLAIN_LAST = "regexp_extract({x}, '[^/]*$')"
_DOTS = "replace(imp, '.', '/')"
_ROOT_KEYS = ", ".join(f"CASE WHEN NOT platform THEN '{r}/' || {_DOTS} END, CASE WHEN NOT platform THEN '{r}/' || {_PLAIN_LAST.format(x=_DOTS)} END" for r in imports.SOURCE_ROOTS)
_RESOLVE = _INDEX + f""", imps AS (SELECT DISTINCT trim(unnest(imports)) AS imp FROM f),
tried AS (SELECT imp, unnest(keys) AS key, generate_subscripts(keys, 1) AS pos FROM (SELECT imp, [CASE WHEN NOT platform THEN {_DOTS} END, {_ROOT_KEYS}, imp, {_PLAIN_LAST.format(x="imp")},
  CASE WHEN contains(imp, '.') THEN {_DOTS} END, CASE WHEN contains(imp, '.') THEN {_PLAIN_LAST.format(x=_DOTS)} END] AS keys
  FROM (SELECT imp, {" OR ".join(f"starts_with(imp, '{p}')" for p in imports.JAVA_PLATFORM)} AS platform FROM imps WHERE imp <> '' AND NOT starts_with(imp, ':') AND NOT ends_with(imp, '*')))),
hit AS (SELECT imp, pos, path FROM tried JOIN ix USING (key)),
res AS (SELECT DISTINCT h.imp AS "import", h.path FROM hit h JOIN (SELECT imp, min(pos) AS pos FROM hit GROUP BY imp) b USING (imp, pos))"""
_WINDOW = _BASE + """, w AS (SELECT full_name AS symbol, greatest(start_line - 10, 1)::INT AS first, least(end_line + 10, line_count)::INT AS last, line_count
  FROM c LEFT JOIN f ON c.file_id = f.id),
ctx AS (SELECT symbol, CASE WHEN line_count IS NOT NULL THEN first END AS first, CASE WHEN line_count IS NOT NULL THEN last END AS last,
  CASE WHEN line_count IS NOT NULL THEN greatest(last - first + 1, 0) ELSE 0 END::INT AS hit_lines, line_count FROM w)"""

ORACLES = {
    "language_counts": _BASE + f" SELECT {_LANG.format(p=_PATH)} AS language, count(*) AS files FROM f GROUP BY ALL",
    "file_measures": """WITH t AS (SELECT 'f' || file_id || '.go' AS absolute_path, coalesce(content, '') AS content FROM file_text),
n AS (SELECT *, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END::INT AS line_count FROM t)
SELECT absolute_path, 'go' AS language, CASE WHEN line_count > 150 THEN '' ELSE sha256(content) END AS content_hash, line_count, strlen(content)::BIGINT AS byte_size,
  CASE WHEN line_count > 150 THEN 'parse_skipped' ELSE 'parse_ok' END AS parse_status FROM n""",
    "graph_edges": _EDGE + " SELECT src, dst FROM e",
    "graph_size": _EDGE + " SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM e) AS edges",
    "degrees": _EDGE + " SELECT * FROM deg",
    "orphan_methods": _EDGE + " SELECT node FROM deg WHERE n_in = 0",
    "hot_methods": _EDGE + " SELECT node, n_in FROM deg ORDER BY n_in DESC, node LIMIT 20",
    "direct_callers": _EDGE + " SELECT src FROM e WHERE dst = (SELECT node FROM hot)",
    "khop_callers": _EDGE + _HOP.format(start="hot", far="src", near="dst", n=2) + " SELECT * FROM least WHERE depth > 0",
    "khop_callees": _EDGE + _HOP.format(start="busy", far="dst", near="src", n=3) + " SELECT * FROM least WHERE depth > 0",
    "shortest_path_length": _EDGE + _HOP.format(start="busy", far="dst", near="src", n=3) + " SELECT max(depth)::BIGINT AS steps FROM least",
    "hierarchy_edges": _BASE + """ SELECT DISTINCT src, dst FROM (SELECT trim(full_name) AS src, trim(unnest(parent_fqns)) AS dst FROM c) WHERE src <> '' AND dst <> ''""",
    "reverse_references": _BASE + " SELECT DISTINCT absolute_path AS path, unnest(referenced_by_files) AS referenced_by FROM f",
    "file_nodes": _BASE + """ SELECT f.id, absolute_path, language, coalesce(n, 0) AS classes, coalesce(k, 0) AS methods FROM f
LEFT JOIN (SELECT file_id, count(*) AS n FROM c GROUP BY file_id) a ON a.file_id = f.id
LEFT JOIN (SELECT c.file_id, count(*) AS k FROM m JOIN c ON m.class_id = c.id GROUP BY c.file_id) b ON b.file_id = f.id""",
    "import_index": _INDEX + " SELECT key, path FROM ix",
    "import_resolve": _RESOLVE + ' SELECT "import", path FROM res',
    "file_graph": _RESOLVE + """ SELECT DISTINCT src, path AS dst FROM (SELECT absolute_path AS src, trim(unnest(imports)) AS imp FROM f) u JOIN res ON u.imp = res."import" WHERE src <> path""",
    "upsert_latest": "SELECT id, caller_fqn, callee_fqn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM code_call) WHERE rn = 1",
    "replace_by_owner": """SELECT id, file_id, (coalesce(line_number, -1) + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS line_number
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM code_call) WHERE rn = 1""",
    "cascade_delete": _TAGS + ", " + _MTAGS + """, gc AS (SELECT id FROM c WHERE file_id IN (SELECT id FROM f WHERE id % 4 = 1)), gm AS (SELECT id FROM m WHERE class_id IN (SELECT id FROM gc))
SELECT 'file' AS name, (SELECT count(*) FROM f WHERE id % 4 <> 1) AS n UNION ALL SELECT 'class', (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM gc))
UNION ALL SELECT 'method', (SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM gm))
UNION ALL SELECT 'call', (SELECT count(DISTINCT id) FROM code_call WHERE file_id NOT IN (SELECT id FROM f WHERE id % 4 = 1))
UNION ALL SELECT 'class_tag', (SELECT count(*) FROM ct WHERE class_id NOT IN (SELECT id FROM gc)) UNION ALL SELECT 'method_tag', (SELECT count(*) FROM mt WHERE method_id NOT IN (SELECT id FROM gm))""",
    "hash_gate": _BASE + " SELECT DISTINCT absolute_path FROM f WHERE length(absolute_path) % 5 = 0 AND content_hash IS NOT NULL",
    "entity_diff": _BASE + """, o AS (SELECT full_name, start_line, end_line FROM c WHERE start_line % 7 <> 1),
n AS (SELECT full_name, start_line + CASE WHEN end_line % 3 = 0 THEN 1000 ELSE 0 END AS start_line, end_line + CASE WHEN end_line % 3 = 0 THEN 1000 ELSE 0 END AS end_line FROM c WHERE start_line % 5 <> 2)
SELECT full_name, CASE WHEN n.start_line IS NULL THEN 'DELETE' WHEN o.start_line IS NULL THEN 'INSERT'
  WHEN o.start_line <= o.end_line AND n.start_line <= n.end_line AND o.start_line <= n.end_line AND n.start_line <= o.end_line THEN 'UPDATE' ELSE 'RELOCATE' END AS action
FROM o FULL JOIN n USING (full_name)""",
    "class_tags": _TAGS + " SELECT class_id, tag FROM ct",
    "domain_tags": _TAGS + _DOMAIN + " SELECT class_id, tag FROM dom",
    "all_class_tags": _TAGS + _DOMAIN + " SELECT class_id, tag FROM ct UNION SELECT class_id, tag FROM dom",
    "method_tags": _BASE + ", " + _MTAGS + " SELECT method_id, tag FROM mt",
    "tag_and_search": _TAGS + " SELECT class_id FROM ct WHERE tag IN ('cache', 'java') GROUP BY class_id HAVING count(DISTINCT tag) = 2",
    "tag_counts": _TAGS + " SELECT CASE " + " ".join(
        f"WHEN tag IN ({', '.join(repr(n) for n in names)}) THEN '{cat}'" for cat, names in store.TAG_CATEGORY.items()
    ) + " ELSE 'biz' END AS category, count(DISTINCT tag) AS tags, count(*) AS links FROM ct GROUP BY ALL",
    "symbol_enrichment": _BASE + """ SELECT s.id AS symbol, regexp_extract(s.id, '^(class|method|file):', 1) AS kind, coalesce(f1.absolute_path, f2.absolute_path, '') AS file
FROM (SELECT DISTINCT id FROM fts_entry) s LEFT JOIN c c1 ON s.id = 'class:' || c1.id LEFT JOIN f f1 ON c1.file_id = f1.id
LEFT JOIN m ON s.id = 'method:' || m.id LEFT JOIN c c2 ON m.class_id = c2.id LEFT JOIN f f2 ON c2.file_id = f2.id""",
    "index_documents": _BASE + """ SELECT 'class:' || c.id AS doc_id, length(concat_ws(' ', full_name, type, doc_comment, absolute_path))::INT AS size FROM c LEFT JOIN f ON c.file_id = f.id
UNION ALL SELECT 'method:' || id, length(concat_ws(' ', full_name, signature, doc_comment))::INT FROM m
UNION ALL SELECT 'file:' || absolute_path, length(absolute_path)::INT FROM f WHERE id NOT IN (SELECT file_id FROM c WHERE file_id IS NOT NULL)""",
    "context_window": _WINDOW + """ SELECT symbol, coalesce(first, 0) AS first, coalesce(last, 0) AS last, hit_lines, hit_lines * 4 AS token_estimate,
  CASE WHEN line_count IS NOT NULL THEN greatest(line_count - hit_lines, 0) ELSE 0 END::INT AS trimmed_lines, CASE WHEN line_count IS NULL THEN 'file_unreadable' ELSE 'context_lines' END AS trim_reason FROM ctx""",
    "context_totals": _WINDOW + " SELECT count(*) AS symbols, sum(hit_lines)::BIGINT AS lines, sum(hit_lines * 4)::BIGINT AS tokens FROM ctx",
    "window_text": _BASE + """, l AS (SELECT file_id, string_split(regexp_replace(content, '\\n+$', ''), chr(10)) AS lines FROM file_text WHERE regexp_replace(content, '\\n+$', '') <> '')
SELECT c.id AS symbol, array_to_string(lines[start_line:start_line + 1], chr(10)) AS text FROM c JOIN l USING (file_id) WHERE start_line > 0 AND start_line <= len(lines)""",
    "doc_lines": _BASE + """ SELECT id, CASE WHEN length(t) > 60 THEN left(t, 60) || '...' ELSE t END AS line
FROM (SELECT id, replace(replace(doc_comment, chr(10), ' '), chr(13), '') AS t FROM c)""",
    "nearest_class": _BASE + """, x AS (SELECT c.file_id, m.start_line AS line, m.full_name AS name FROM m JOIN c ON m.class_id = c.id WHERE m.start_line IS NOT NULL)
SELECT x.file_id, x.line, x.name, max_by(k.full_name, (k.start_line, k.full_name)) AS owner FROM x LEFT JOIN c k ON k.file_id = x.file_id AND k.start_line <= x.line GROUP BY x.file_id, x.line, x.name""",
    "caller_files": _EDGE + """ SELECT caller, min(absolute_path) AS path FROM (SELECT DISTINCT src AS caller FROM e) JOIN c ON caller = c.full_name OR starts_with(caller, c.full_name || '.')
JOIN f ON c.file_id = f.id GROUP BY caller""",
}
