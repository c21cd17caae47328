"""Registered queries, sixth part: stored snapshots, updates, scalars over whole tables, support and layers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import audit, intervals, lineage, postings, traverse
from quern.plans import encode
from quern.plans import encode_code as src
from quern.plans.catalog import _AB, _snapshots, query
from quern.plans.catalog_trace import _CATEGORY, _category, sym_query
from quern.plans.encode import table
from quern.sources import snapshot
from quern.sources.staging import shared_root


def _root(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _graph(spark, d):
    return {"entity": encode.entities(spark, d), "relation": encode.relations(spark, d)}


def _written(spark, d, tables=None, **meta) -> snapshot.Snapshot:
    root = _root(spark, "product")
    tables = tables or _graph(spark, d)
    digest = audit.digest(tables["relation"], ["kind", "src", "dst", "status", "trust"]).first().digest
    snapshot.write(root, tables, {"digest": digest, **meta}, {"entity": "id", "relation": "src"})
    return snapshot.shared(spark, root)


def _count(frame, **constants):
    return frame.agg(F.count(F.lit(1)).alias("n")).select(*(F.lit(v).alias(k) for k, v in constants.items()), "n")


# -- snapshots ------------------------------------------------------------------------


@query("SELECT 'entity' AS \"table\", kind, count(*)::BIGINT AS n FROM ent GROUP BY kind UNION ALL SELECT 'relation', kind, count(*)::BIGINT FROM rel GROUP BY kind")
def src1_opened_snapshot(spark, d):
    """A snapshot is written, opened through the pool, and counted from its own files."""
    s = _written(spark, d)
    by = lambda n: s.table(n).groupBy(F.lit(n).alias("table"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return by("entity").unionByName(by("relation"))


@query("SELECT key, value FROM (VALUES ('schema', 'quern/2'), ('architecture', 'arch35')) t(key, value) UNION ALL SELECT 'entity_count', count(*)::VARCHAR FROM ent UNION ALL SELECT 'relation_count', count(*)::VARCHAR FROM rel")
def src3_stored_meta(spark, d):
    """Metadata as it is read back from a snapshot."""
    g = _graph(spark, d)
    s = _written(spark, d, g, architecture="arch35", entity_count=str(g["entity"].count()), relation_count=str(g["relation"].count()))
    return s.spark.read.parquet(f"{s.root}/{s.version}/meta").where(~F.col("key").isin("version", "digest"))


@query("SELECT 'nations' AS product, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'regions', count(*)::BIGINT FROM region", graph=False)
def src4_products(spark, d):
    """Snapshots found below a project folder, with the size of each."""
    project = _root(spark, "project")
    for name, source in (("nations", "nation"), ("regions", "region")):
        snapshot.write(f"{project}/{name}", {"row": table(spark, d, source)}, {})
    out = None
    for name in snapshot.products(spark, project):
        part = _count(snapshot.shared(spark, f"{project}/{name}").table("row"), product=name)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT kind, count(*)::BIGINT AS n, true AS refused_when_stale FROM rel GROUP BY kind")
def src5_checked_view(spark, d):
    """A stored projection is read while its digest is the graph's, and refused when it is not."""
    s = _written(spark, d)
    kinds = s.table("relation").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    s.store_view("kinds", kinds)
    s.store_view("stale", kinds, digest="of another graph")
    try:
        s.view("stale")
        refused = False
    except ValueError:
        refused = True
    return s.view("kinds").withColumn("refused_when_stale", F.lit(refused))


@query("SELECT src AS owner, count(*)::BIGINT AS parts FROM rel WHERE kind = 'CONTAINS' GROUP BY src")
def src6_projected_view(spark, d):
    """A view made anew from the slice of the snapshot that it needs."""
    return _written(spark, d).table("relation", ["CONTAINS"]).groupBy(F.col("src").alias("owner")).agg(F.count(F.lit(1)).alias("parts"))


@query("+known AS (SELECT id FROM ent WHERE NOT (kind = 'PART' AND line_start % 10 = 3)) SELECT kind, count(*)::BIGINT AS n FROM rel WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known) GROUP BY kind")
def snk1_written_snapshot(spark, d):
    """A graph with missing parts is written without the relations that would dangle."""
    e = encode.entities(spark, d).where("NOT (kind = 'PART' AND line_start % 10 = 3)")
    s = _written(spark, d, {"entity": e, "relation": audit.grounded(encode.relations(spark, d), e)})
    return s.table("relation").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT leaf, count(DISTINCT id)::BIGINT AS n, 1::INT AS added_first, 0::INT AS added_again FROM (SELECT lower(name) AS leaf, id FROM ent UNION ALL SELECT lower(regexp_extract(name, '[^#.:]*$')), id FROM ent) GROUP BY leaf")
def snk4_upgraded_snapshot(spark, d):
    """The derived name table is added to a snapshot that lacks it, once."""
    s = _written(spark, d)
    leaves = lambda snap: snap.table("entity").select(F.explode(names.leaf_variants(F.col("name"))).alias("leaf"), "id").distinct()
    first, again = s.upgrade({"name_leaf": leaves}), s.upgrade({"name_leaf": leaves})
    n = s.table("name_leaf").groupBy("leaf").agg(F.count_distinct("id").alias("n"))
    return n.withColumn("added_first", F.lit(len(first))).withColumn("added_again", F.lit(len(again)))


@query("SELECT kind, src, dst FROM rel WHERE kind = 'CONTAINS'")
def snk5_dumped_view(spark, d):
    """A view exported as JSON lines and read back."""
    where = f"{_root(spark, 'dump')}/view"
    encode.relations(spark, d).where("kind = 'CONTAINS'").select("kind", "src", "dst").write.json(where)
    return spark.read.schema("kind string, src string, dst string").json(where)


_CHANGED = _AB + ", ch AS (SELECT path, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.sha IS DISTINCT FROM b.sha)"


@query(_CHANGED + ", l AS (SELECT doc_id::VARCHAR AS path, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) SELECT path, change, n::BIGINT AS nodes FROM ch JOIN l USING (path)", graph=False)
def snk6_exported_diff(spark, d):
    """Changed files with the number of located nodes (lines) in each."""
    nodes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.size(F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x) != "")).cast("long").alias("nodes"))
    return audit.changed(*_snapshots(spark, d)).join(nodes, "path")


@query("SELECT n_name AS key, CASE WHEN n_regionkey >= 2 THEN r_name ELSE n_regionkey::VARCHAR END AS value FROM nation JOIN region ON r_regionkey = n_regionkey", graph=False)
def snk7_upserted_meta(spark, d):
    """Scalar facts of a table added to a snapshot's own, the later value of a key staying."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    root = _root(spark, "meta")
    own = {r.n_name: str(r.n_regionkey) for r in nation.collect()}  # metadata: a fact per nation
    snapshot.write(root, {"row": region}, own)
    later = nation.where("n_regionkey >= 2").join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    snapshot.Snapshot(spark, root).upsert_meta(**{r.n_name: r.r_name for r in later.collect()})
    facts = [(k, v) for k, v in snapshot.Snapshot(spark, root).meta().items() if k not in ("schema", "version")]
    return spark.createDataFrame(facts, "key string, value string")


@query("SELECT p_type AS block_id, dim, list_sort(list(DISTINCT value)) AS values, count(DISTINCT value) = 1 AS fixed FROM (SELECT p_type, unnest(['brand', 'size']) AS dim, unnest([p_brand, (p_size % 8)::VARCHAR]) AS value FROM part) GROUP BY ALL", graph=False)
def snk3_block_postings(spark, d):
    """Template blocks with the domain of each dim, and whether it is a single value."""
    pairs = F.explode(F.array(F.struct(F.lit("brand").alias("dim"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("dim"), (F.col("p_size") % 8).cast("string").alias("value"))))
    rows = table(spark, d, "part").select(F.col("p_type").alias("block_id"), pairs.alias("x")).select("block_id", "x.dim", "x.value")
    return rows.groupBy("block_id", "dim").agg(F.sort_array(F.collect_set("value")).alias("values"), (F.count_distinct("value") == 1).alias("fixed"))


# -- updates --------------------------------------------------------------------------

_ROLES = "CASE source WHEN 'src0' THEN 'host' WHEN 'src1' THEN 'kernel' WHEN 'src2' THEN 'common' ELSE 'other' END"


def _roles(column):
    return F.when(column == "src0", "host").when(column == "src1", "kernel").when(column == "src2", "common").otherwise("other")


@query(_CHANGED + f""", r AS (SELECT ch.path, {_ROLES} AS role FROM ch JOIN documents ON doc_id::VARCHAR = ch.path),
l AS (SELECT role, count(*) AS files, unnest(CASE role WHEN 'host' THEN ['host', 'compile', 'commit'] WHEN 'kernel' THEN ['kernel', 'compile', 'commit'] WHEN 'common' THEN ['host', 'kernel', 'template', 'compile', 'commit'] ELSE [] END) AS layer FROM r GROUP BY role)
SELECT layer, list_sort(list(DISTINCT role)) AS because, CASE WHEN (SELECT count(DISTINCT layer) FROM l) = 0 THEN 'noop' WHEN (SELECT count(DISTINCT layer) FROM l) >= 4 THEN 'full_extract' ELSE 'selective' END AS mode FROM l GROUP BY layer""", graph=False)
def upd5_planned_layers(spark, d):
    """The layers that changed files need, why, and the mode of the update that follows."""
    where = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), _roles(F.col("source")).alias("role"))
    return audit.planned_layers(audit.changed(*_snapshots(spark, d)).join(where, "path"))


@query(_CHANGED + " SELECT count(*)::BIGINT AS n, sha256(string_agg(path || ':' || change, ',' ORDER BY path)) AS fingerprint FROM ch", graph=False)
def upd7_change_set_fingerprint(spark, d):
    """An idempotence key of a change set: of its sorted paths, which are what changed and not the corpus."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "change"))), lambda x: F.concat(x["path"], F.lit(":"), x["change"])), ",")
    return audit.changed(*_snapshots(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.sha2(listed, 256).alias("fingerprint"))


@query(_AB + " SELECT b.path, a.sha IS NOT NULL AS cached FROM b LEFT JOIN (SELECT DISTINCT sha FROM a) a ON a.sha = b.sha", graph=False)
def upd9_scan_cache(spark, d):
    """Files of the new state whose content was scanned before, under whatever path."""
    old, new = _snapshots(spark, d)
    return new.join(old.select("sha", F.lit(True).alias("hit")).distinct(), "sha", "left").select("path", F.coalesce("hit", F.lit(False)).alias("cached"))


@query(_CHANGED + " SELECT path, sha FROM b UNION ALL SELECT a.path, a.sha FROM a WHERE a.path NOT IN (SELECT path FROM b) AND a.path NOT IN (SELECT path FROM ch)", graph=False)
def upd10_applied_update(spark, d):
    """The old state with only its changed files replaced, added or dropped, as the next version of a snapshot."""
    old, new = _snapshots(spark, d)
    root = _root(spark, "update")
    snapshot.write(root, {"file": old}, {}, {"file": "path"})
    changes = audit.changed(old, new)
    base = snapshot.Snapshot(spark, root).table("file")
    kept = base.join(changes, "path", "left_anti")
    fresh = new.join(changes.where("change <> 'removed'"), "path", "left_semi")
    snapshot.write(root, {"file": kept.unionByName(fresh)}, {}, {"file": "path"})
    return snapshot.Snapshot(spark, root).table("file")


@query(_AB + r""", t AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 19 <> 0)
SELECT b.path, b.sha NOT IN (SELECT sha FROM a WHERE sha IS NOT NULL) AS scanned, len(regexp_extract_all(t.text, '[A-Za-z_][A-Za-z0-9_]*'))::BIGINT AS n_names FROM b JOIN t USING (path)""", graph=False)
def upd9_cached_scan(spark, d):
    """Facts of the new state's files from a stored cache, of which only contents that the old state had not were scanned."""
    from quern.sources.versions import ScanCache

    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    state = lambda rows, text: rows.select("path", F.sha2(text, 256).alias("sha"), text.alias("text"))
    old, new = state(docs.where("doc_id % 17 <> 0"), F.col("text")), state(docs.where("doc_id % 19 <> 0"), edited)
    scanner = lambda rows: rows.select("sha", F.size(names.identifiers(F.col("text"))).cast("long").alias("facts"))
    root = _root(spark, "scans")
    ScanCache(spark, root, "names/1").scan(old, scanner)
    cache = ScanCache(spark, root, "names/1")
    facts, _ = cache.scan(new, scanner)
    before = old.select("sha", F.lit(True).alias("known")).distinct()
    return facts.join(before, "sha", "left").select("path", F.col("known").isNull().alias("scanned"), F.col("facts").alias("n_names"))


@query(_CHANGED + " SELECT path, sha FROM b UNION ALL SELECT a.path, a.sha FROM a WHERE a.path NOT IN (SELECT path FROM b) AND a.path NOT IN (SELECT path FROM ch)", graph=False)
def upd10_shared_versions(spark, d):
    """The next version of a stored state, whose unchanged buckets are the files of the version before."""
    from quern.sources.versions import Versions

    old, new = _snapshots(spark, d)
    stored = Versions(spark, _root(spark, "versions"), "path")
    stored.apply(old)
    changes = audit.changed(stored.read(), new)
    stored.apply(new.join(changes.where("change <> 'removed'"), "path", "left_semi"), changes.where("change = 'removed'").select("path"))
    return stored.read()


# -- whole-table scalars --------------------------------------------------------------


@query("SELECT id, regexp_extract(name, '[^#.:]*$') AS leaf FROM ent")
def sf1_leaf_names(spark, d):
    return encode.entities(spark, d).select("id", names.leaf(F.col("name")).alias("leaf"))


@query("SELECT id, upper(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')) AS slug, trim(regexp_replace('  ' || name || '  &&  x ', '\\s+', ' ', 'g')) AS guard, 'op/' || file AS path FROM ent")
def sf3_normal_forms(spark, d):
    """Slugs, guards with single spaces, and paths below a root with forward slashes."""
    e = encode.entities(spark, d)
    guard = names.normal_space(F.concat(F.lit("  "), "name", F.lit("  &&  x ")))
    path = names.rel_path(F.concat(F.lit("/root/op\\"), "file"), "/root")
    return e.select("id", names.slug(F.col("name")).alias("slug"), guard.alias("guard"), path.alias("path"))


@query("SELECT 'R_' || kind || '_' || substr(sha1(kind || '|' || src || '|' || dst), 1, 12) AS id FROM rel")
def sf4_edge_ids(spark, d):
    return encode.relations(spark, d).select(names.edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"))


@sym_query("SELECT DISTINCT path, (CASE WHEN path LIKE '%/common/%' THEN 2 WHEN path LIKE 'op_host/%' THEN 0 WHEN path LIKE 'op_kernel/%' THEN 1 ELSE 3 END)::INT AS layer, (CASE WHEN path LIKE '%/common/%' THEN -10 ELSE 20 END)::INT AS locality, (CASE WHEN path LIKE '%/common/%' THEN 3 WHEN path LIKE '%/arch35/%' THEN 0 ELSE 1 END)::INT AS arch FROM code")
def sf7_path_ranks(spark, d):
    """Layer, locality and architecture rank of every path; common is tested first."""
    from quern.operators import rank

    p = F.col("path")
    return src.code_lines(spark, d).select(p).distinct().select(p, names.path_layer(p).alias("layer"), rank.locality(p).alias("locality"), rank.arch_rank(p, "arch35").alias("arch"))


@query(r"""+t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM line) SELECT token, list_transform(regexp_extract_all(token, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)) AS parts FROM t""")
def sf8_identifier_parts(spark, d):
    """Every identifier of all lines, cut at case changes, digits and underscores."""
    tokens = encode.source_lines(spark, d).select(F.explode(names.identifiers(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", names.identifier_parts(F.col("token")).alias("parts"))


@sym_query("SELECT path, min(line)::INT AS first, max(line)::INT AS last, count(*)::BIGINT AS n FROM (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM (SELECT DISTINCT path, line FROM wr)) GROUP BY path, g")
def sf12_write_runs(spark, d):
    """Runs of consecutive lines that write."""
    return intervals.line_runs(src.writes(spark, d).select("path", "line").distinct(), ["path"])


@sym_query("SELECT kind, src, dst, path, line, (row_number() OVER (PARTITION BY kind, src, dst ORDER BY path, line))::INT AS site, n_sites FROM (SELECT DISTINCT s.*, e.n_sites FROM site2 s JOIN sedge e USING (kind, src, dst))")
def exp2_call_rows(spark, d):
    """One row per site of every edge, numbered, with the edge's number of sites."""
    sites = src.symbol_sites(spark, d).distinct().join(src.symbol_edges(spark, d).select("kind", "src", "dst", "n_sites"), ["kind", "src", "dst"])
    return sites.withColumn("site", F.row_number().over(Window.partitionBy("kind", "src", "dst").orderBy("path", "line")))


@query("SELECT p_partkey, unnest(['0x' || hex(p_partkey), '0b' || bin(p_size), p_size || 'u', p_partkey || 'UL']) AS literal, unnest([p_partkey::VARCHAR, p_size::VARCHAR, p_size::VARCHAR, p_partkey::VARCHAR]) AS value FROM part", graph=False)
def flt8_integer_literals(spark, d):
    """Hexadecimal, binary and suffixed literals as decimal text."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    shown = F.array(F.concat(F.lit("0x"), F.hex("p_partkey")), F.concat(F.lit("0b"), F.bin("p_size")), F.concat(s, F.lit("u")), F.concat(k, F.lit("UL")))
    return table(spark, d, "part").select("p_partkey", F.explode(shown).alias("literal")).select("p_partkey", "literal", names.integer_text(F.col("literal")).alias("value"))


@query("+known AS (SELECT id FROM ent WHERE NOT (kind IN ('PART', 'SUPPLIER') AND line_start % 10 = 3)), x AS (SELECT kind, src, dst, unnest([src, dst]) AS missing FROM rel) SELECT * FROM x WHERE missing NOT IN (SELECT id FROM known)")
def jn10_dangling_edges(spark, d):
    """Edges of every kind with an end that is no entity; some parts and suppliers are left out as the defect."""
    known = encode.entities(spark, d).where("NOT (kind IN ('PART', 'SUPPLIER') AND line_start % 10 = 3)")
    return audit.dangling(encode.relations(spark, d), known)


@query("+l AS (SELECT path, line, CASE WHEN line % 4 = 0 THEN NULL ELSE text END AS text FROM line), k AS (SELECT path, max(line) FILTER (text IS NOT NULL) AS n FROM l GROUP BY path), g AS (SELECT path, unnest(range(1, n + 1))::INT AS line FROM k WHERE n IS NOT NULL) SELECT g.path, g.line, coalesce(l.text, '') AS text FROM g LEFT JOIN l ON l.path = g.path AND l.line = g.line")
def lc5_restored_lines(spark, d):
    """Blank lines, which are not stored, put back between the stored ones; every fourth line is taken out as blank."""
    stored = encode.source_lines(spark, d).where("line % 4 <> 0")
    return intervals.restored(stored)


@query("""+w AS (SELECT path, a::INT AS a, least(a + 6, n)::INT AS b FROM (SELECT path, n, unnest(range(2, n + 1, 7)) AS a FROM last)), u AS (SELECT path, entity_id, line_start, line_end FROM span WHERE kind <> 'FILE'),
o AS (SELECT w.path, a, b, entity_id, least(b, line_end) - greatest(a, line_start) + 1 AS over, line_end - line_start AS width, a BETWEEN line_start AND line_end AND line_end > line_start AS holds FROM w JOIN u ON u.path = w.path AND line_start <= b AND line_end >= a),
s AS (SELECT path, a, b, entity_id, over FROM (SELECT *, row_number() OVER (PARTITION BY path, a ORDER BY width, entity_id) AS r FROM o WHERE holds) WHERE r = 1), m AS (SELECT path, a, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY path, a ORDER BY over DESC, width, entity_id) AS r FROM o) WHERE r = 1)
SELECT w.path, w.a AS line, CASE WHEN s.entity_id IS NOT NULL AND (2 * s.over >= w.b - w.a + 1 OR w.b <= w.a) THEN s.entity_id ELSE m.entity_id END AS entity_id FROM w LEFT JOIN s ON s.path = w.path AND s.a = w.a LEFT JOIN m ON m.path = w.path AND m.a = w.a""")
def lc2_window_identity(spark, d):
    """The unit that names a window: the one around its start if it covers half of it, else the one it overlaps most."""
    s = encode.spans(spark, d)
    last = s.where("kind = 'FILE'").select("path", F.col("line_end").alias("n"))
    w = last.where("n >= 2").select("path", "n", F.explode(F.sequence(F.lit(2), F.col("n"), F.lit(7))).alias("w_start")).withColumn("w_end", F.least(F.col("w_start") + 6, "n")).drop("n")
    return intervals.window_identity(w, s.where("kind <> 'FILE'").drop("kind")).select("path", F.col("w_start").alias("line"), "entity_id")


# -- support, categories and layers ---------------------------------------------------


@query("""+k AS (SELECT key_id FROM dim WHERE dim = 'size' AND value = '3') SELECT 'value' AS fact, 'size' AS dim, value, count(*)::BIGINT AS n FROM dim WHERE dim = 'size' GROUP BY value
UNION ALL SELECT 'cross', u.dim, u.value, count(DISTINCT k.key_id)::BIGINT FROM (SELECT DISTINCT dim, value FROM dim WHERE dim <> 'size') u LEFT JOIN dim x ON u.dim = x.dim AND u.value = x.value LEFT JOIN k ON k.key_id = x.key_id GROUP BY ALL
UNION ALL SELECT 'without', dim, value, count(DISTINCT key_id)::BIGINT FROM dim WHERE dim <> 'size' AND key_id NOT IN (SELECT key_id FROM k) GROUP BY ALL""")
def ag10_compiled_support(spark, d):
    """What supports a value: the counts of its dim, the keys beside it with zeros, and the keys that have another value."""
    return postings.support(encode.key_dims(spark, d), "size", "3")


@sym_query(f"+c AS (SELECT path, function, {_CATEGORY} AS category, count(*)::BIGINT AS n FROM call GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY path, function ORDER BY n DESC, category))::INT AS rank FROM c")
def ag16_operations_per_function(spark, d):
    """What each function does by category, most frequent first."""
    n = src.calls(spark, d).groupBy("path", "function", _category(F.col("callee")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("path", "function").orderBy(F.desc("n"), "category")))


@sym_query("""+x AS (SELECT kind, dst, src LIKE '%@op_kernel/%' AS kernel FROM sedge WHERE kind IN ('WRITES', 'READS')) SELECT dst AS field, count(*) FILTER (kind = 'WRITES' AND NOT kernel)::BIGINT AS producers, count(*) FILTER (kind = 'READS' AND kernel)::BIGINT AS consumers,
CASE WHEN count(*) FILTER (kind = 'WRITES' AND NOT kernel) > 0 AND count(*) FILTER (kind = 'READS' AND kernel) > 0 THEN 'host_to_kernel' WHEN count(*) FILTER (kind = 'WRITES' AND kernel) > 0 AND count(*) FILTER (kind = 'READS' AND kernel) > 0 THEN 'in_kernel' ELSE 'none' END AS transport FROM x GROUP BY dst""")
def ag15_host_kernel_transport(spark, d):
    """Producers on the host, consumers in the kernel, and how each field gets from one to the other."""
    w, r, k = F.col("kind") == "WRITES", F.col("kind") == "READS", F.col("src").contains("@op_kernel/")
    g = src.symbol_edges(spark, d).where("kind IN ('WRITES', 'READS')").groupBy(F.col("dst").alias("field")).agg(F.count_if(w & ~k).alias("producers"), F.count_if(r & k).alias("consumers"), F.count_if(w & k).alias("kw"))
    transport = F.when((F.col("producers") > 0) & (F.col("consumers") > 0), "host_to_kernel").when((F.col("kw") > 0) & (F.col("consumers") > 0), "in_kernel").otherwise("none")
    return g.select("field", "producers", "consumers", transport.alias("transport"))


@sym_query("""+x AS (SELECT c.callee, c.path, b.id FROM call c LEFT JOIN bind b ON b.leaf = c.callee) SELECT CASE WHEN id IS NOT NULL THEN 'settled' WHEN starts_with(callee, 'Run') THEN 'missing_body' WHEN regexp_matches(callee, '^(set_|Get)') THEN 'accessor' WHEN callee = 'OP_CHECK' THEN 'macro' ELSE 'external' END AS bucket, CASE WHEN path LIKE 'op_kernel/%' THEN 'kernel' ELSE 'host' END AS side, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def ag26_gap_buckets(spark, d):
    """Calls by why they are open, on each side."""
    from quern.operators import merge

    bound = merge.unique_or_nothing(src.symbols(spark, d).where("kind = 'FUNCTION'").select(names.leaf(F.col("name")).alias("callee"), "id"), "callee", "id")
    x = src.calls(spark, d).join(bound, "callee", "left")
    c = F.col("callee")
    bucket = F.when(F.col("id").isNotNull(), "settled").when(c.startswith("Run"), "missing_body").when(c.rlike("^(set_|Get)"), "accessor").when(c == "OP_CHECK", "macro").otherwise("external")
    side = F.when(F.col("path").startswith("op_kernel/"), "kernel").otherwise("host")
    return x.groupBy(bucket.alias("bucket"), side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@sym_query("SELECT path, line, callee FROM call WHERE lower(callee) = 'set' AND path LIKE 'op_kernel/%' AND function LIKE 'Op3::%'")
def flt6_attribute_predicates(spark, d):
    """Calls by callee whatever its case, layer and function."""
    c = src.calls(spark, d).where((F.lower("callee") == "set") & (names.path_layer(F.col("path")) == 1) & F.col("function").startswith("Op3::"))
    return c.select("path", "line", "callee")


@sym_query(r"+n AS (SELECT DISTINCT callee AS name FROM call UNION SELECT DISTINCT regexp_extract(text, '^\s*(\w+)', 1) FROM clean UNION SELECT DISTINCT 'std::' || callee FROM call) SELECT name FROM n WHERE NOT regexp_matches(name, '^(std::.*|operator\W.*|if|for|while|switch|return|do|else|case|OP_CHECK\w*|OP_LOG\w*)$')")
def flt13_without_noise(spark, d):
    """Names less library names, operators, flow keywords and validation macros."""
    called = src.calls(spark, d).select(F.col("callee").alias("name"))
    first = src.bodies(spark, d).select(F.regexp_extract("text", r"^\s*(\w+)", 1).alias("name"))
    library = called.select(F.concat(F.lit("std::"), "name").alias("name"))
    return called.unionByName(first).unionByName(library).distinct().where(~names.is_noise(F.col("name")))


@sym_query("SELECT id, CASE WHEN kind = 'MACRO' THEN 'template' WHEN file LIKE '%/common/%' THEN 'common' WHEN file LIKE 'op_kernel/%' THEN 'kernel' ELSE 'host' END AS layer FROM sym")
def prj5_layers(spark, d):
    """The layer of a symbol, by its kind and then by where it stands."""
    f = F.col("file")
    return src.symbols(spark, d).select("id", F.when(F.col("kind") == "MACRO", "template").when(f.contains("/common/"), "common").when(f.startswith("op_kernel/"), "kernel").otherwise("host").alias("layer"))


@sym_query("SELECT path, line, regexp_matches(text, '^\\s*(template\\s*<|ARGS_(DECL|SEL)|#define)') AS template FROM code")
def tx11_template_lines(spark, d):
    return src.code_lines(spark, d).select("path", "line", F.col("text").rlike(r"^\s*(template\s*<|ARGS_(DECL|SEL)|#define)").alias("template"))


@sym_query(f"+o AS (SELECT path, callee, {_CATEGORY} AS category FROM call), b AS (SELECT CASE category WHEN 'check' THEN 'constraint' WHEN 'write' THEN 'state' WHEN 'read' THEN 'source' WHEN 'call' THEN 'flow' ELSE 'compute' END AS bucket FROM o UNION ALL SELECT CASE kind WHEN 'MACRO' THEN 'key' ELSE 'data' END FROM sym WHERE kind <> 'FUNCTION') SELECT bucket, count(*)::BIGINT AS n FROM b GROUP BY bucket")
def rm1_semantic_buckets(spark, d):
    """Operations by the class of their callee and other symbols by kind; empty buckets are absent."""
    c = _category(F.col("callee"))
    of_call = F.when(c == "check", "constraint").when(c == "write", "state").when(c == "read", "source").when(c == "call", "flow").otherwise("compute")
    rows = src.calls(spark, d).select(of_call.alias("bucket")).unionByName(src.symbols(spark, d).where("kind <> 'FUNCTION'").select(F.when(F.col("kind") == "MACRO", "key").otherwise("data").alias("bucket")))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@sym_query("""+q AS (SELECT DISTINCT path, 12 AS line FROM code), s AS (SELECT q.path, q.line, sym.id, sym.kind, sym.name, CASE WHEN q.line BETWEEN line_start AND line_end AND line_end > line_start THEN line_end - line_start ELSE 1000000 END AS around, CASE sym.kind WHEN 'FUNCTION' THEN 0 WHEN 'FIELD' THEN 1 ELSE 2 END AS prio, abs(line_start - q.line) AS away FROM q JOIN sym ON sym.file = q.path)
SELECT path, id, rank FROM (SELECT path, id, (row_number() OVER (PARTITION BY path ORDER BY around, prio, away, name, id))::INT AS rank FROM s) WHERE rank <= 3""")
def rm9_ranked_seeds(spark, d):
    """The three seeds nearest to line 12 of each file: enclosing ones first, narrowest leading, then kind, distance and name."""
    inside = F.lit(12).between(F.col("line_start"), F.col("line_end")) & (F.col("line_end") > F.col("line_start"))
    kind = F.when(F.col("kind") == "FUNCTION", 0).when(F.col("kind") == "FIELD", 1).otherwise(2)
    order = [F.when(inside, F.col("line_end") - F.col("line_start")).otherwise(1000000), kind, F.abs(F.col("line_start") - 12), "name", "id"]
    return traverse.top_per(src.symbols(spark, d).withColumnRenamed("file", "path"), ["path"], order, 3).select("path", "id", "rank")


@sym_query("""SELECT s.id, CASE WHEN s.kind = 'FUNCTION' THEN s.line_end - s.line_start + 1 END::INT AS lines, 'span:' || s.id AS handle, s.file || '#' || s.line_start || '-' || s.line_end AS place FROM sym s""")
def sv4_evidence_handles(spark, d):
    """A handle for every located symbol and the place it leads back to."""
    s = src.symbols(spark, d)
    place = F.concat("file", F.lit("#"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    return s.select("id", F.when(F.col("kind") == "FUNCTION", F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.concat(F.lit("span:"), "id").alias("handle"), place.alias("place"))


@sym_query("SELECT regexp_extract(name, '\\w+$') AS alias, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, count(DISTINCT id)::BIGINT AS candidates FROM sym GROUP BY 1")
def sv5_resolved_aliases(spark, d):
    """Short names with the one id they stand for, or none where several could be meant."""
    s = src.symbols(spark, d).groupBy(names.leaf(F.col("name")).alias("alias")).agg(F.count_distinct("id").alias("candidates"), F.min("id").alias("first"))
    return s.select("alias", F.when(F.col("candidates") == 1, F.col("first")).alias("id"), "candidates")


@sym_query("""SELECT kind, CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN count(*) FILTER (file = '') > 0 THEN 'PARTIAL' ELSE 'ANSWERED' END AS verdict FROM sym GROUP BY kind""")
def sv3_verdicts(spark, d):
    """The verdict of listing each kind: answered when every row is located."""
    g = src.symbols(spark, d).groupBy("kind").agg(F.count_if(F.col("file") == "").alias("loose"))
    return g.select("kind", F.when(F.col("loose") > 0, "PARTIAL").otherwise("ANSWERED").alias("verdict"))


@query("""WITH m AS (SELECT p_partkey, regexp_extract(p_name, '[^ ]*$') AS leaf, p_brand AS owner, p_size % 3 = 0 AS base FROM part), b AS (SELECT leaf, list_sort(list(DISTINCT owner)) AS owners FROM m WHERE base GROUP BY leaf), o AS (SELECT leaf, list_sort(list(DISTINCT owner)) AS owners FROM m WHERE NOT base GROUP BY leaf)
SELECT b.leaf, b.owners AS bases, list_sort(o.owners) AS overrides FROM b JOIN o USING (leaf) WHERE len(list_distinct(list_concat(b.owners, o.owners))) > 1""", graph=False)
def gr32_dispatch_families(spark, d):
    """Families of a base and overrides by another owner: their owners as sets, no pair of them made."""
    m = table(spark, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("leaf"), F.col("p_brand").alias("owner"), "p_size")
    return lineage.dispatch_families(m, "leaf", "owner", F.col("p_size") % 3 == 0)


@query("""+d AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n FROM d""")
def jn11_distinct_words(spark, d):
    """How many different words each text holds, tested inside its array."""
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ", -1))).cast("long").alias("n"))

