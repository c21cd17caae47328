"""Registered queries, seventh part: name tiers and lookups, minted edges, sites, closures over calls and includes, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names, predicates
from quern.operators import audit, cards, intervals, lineage, merge, rank, text, traverse
from quern.plans import encode, service
from quern.plans import encode_code as src
from quern.plans.catalog import ORACLES, _snapshots, query
from quern.plans.catalog_code import _PROV, _provenances, code_query
from quern.plans.catalog_store import _CHANGED
from quern.plans.catalog_trace import sym_query
from quern.plans.encode import table


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


# -- names ----------------------------------------------------------------------------


@sym_query(r"""+n AS (SELECT kind, name FROM sym UNION ALL SELECT 'BRANCH', cond FROM guard), l AS (SELECT kind, name, CASE WHEN kind = 'BRANCH' AND regexp_matches(name, '[()=!<>&|+\-*/%]') THEN [lower(regexp_extract(name, '^[A-Za-z_]\w*'))]
ELSE [lower(name), string_split(lower(name), '::')[-1], string_split(lower(name), '.')[-1]] END AS x FROM n) SELECT DISTINCT kind, name, leaf FROM (SELECT kind, name, unnest(x) AS leaf FROM l) WHERE leaf <> ''""")
def sf2_indexable_leaves(spark, d):
    """What every symbol and branch is looked up by."""
    n = src.symbols(spark, d).select("kind", "name").unionByName(src.guards(spark, d).select(F.lit("BRANCH").alias("kind"), F.col("cond").alias("name"))).distinct()
    return n.select("kind", "name", F.explode(names.indexable_leaves(F.col("kind"), F.col("name"))).alias("leaf"))


@query(r"""+t AS (SELECT path, line, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM line), c AS (SELECT *, s <> '' AND NOT contains(s, '=') AND len(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*')) > 1
AND regexp_matches(regexp_replace(regexp_replace(s, '[A-Za-z_][A-Za-z0-9_]*', '', 'g'), '::|\.', '', 'g'), '\S') AS several FROM t)
SELECT path, line, contains(text, '|') OR contains(text, '.*') AS regex, several, several OR (s <> '' AND NOT contains(s, '=') AND regexp_matches(s, '[\x{4e00}-\x{9fff}]|\s')) AS sentence FROM c""")
def sf9_request_classes(spark, d):
    """Every source line read as a request: is it a regex, several names, a sentence?"""
    return encode.source_lines(spark, d).select("path", "line", *(c.alias(n) for n, c in names.query_classes(F.col("text")).items()))


_FLAG = "CASE p_size % 6 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'FALSE' WHEN 3 THEN '0' WHEN 4 THEN 'False' ELSE '7' END"


@query(f"""WITH f AS (SELECT p_partkey AS key_id, {_FLAG} AS value FROM part), a AS (SELECT unnest(['True', 'true', '0', '7']) AS asked, unnest([['1', 'true', 'True', 'TRUE'], ['1', 'true', 'True', 'TRUE'], ['0', 'false', 'False', 'FALSE'], ['7']]) AS said)
SELECT asked, key_id, value, CASE WHEN value IN ('true', '1') THEN '1' ELSE '0' END AS stored FROM f JOIN a ON list_contains(said, value)""", graph=False)
def nf2_truth_aliases(spark, d):
    """Keys by a truth value however it and they are spelled, and the spelling that is stored."""
    asked = [(a, s) for a in ("True", "true", "0", "7") for s in names.truth_aliases(a)]
    wanted = spark.createDataFrame(asked, "asked string, value string")
    flags = table(spark, d, "part").select(F.col("p_partkey").alias("key_id"), F.expr(_FLAG).alias("value"))
    return flags.join(F.broadcast(wanted), "value").select("asked", "key_id", "value", names.truth(F.col("value")).alias("stored"))


@query("""+l AS (SELECT id, lower(regexp_extract(name, '[^#.:]*$')) AS leaf FROM ent) SELECT leaf, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM ent) + 1) / count(*)), 6) AS idf FROM l GROUP BY leaf""")
def nf8_leaf_idf(spark, d):
    """How rare each leaf is among all entities."""
    e = encode.entities(spark, d).select("id", F.lower(names.leaf(F.col("name"))).alias("leaf"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return rank.document_frequency(e, "leaf", "id").join(F.broadcast(n)).select("leaf", "df", F.round(rank.idf(F.col("df"), F.col("n")), 6).alias("idf"))


_WANTED = ["op3", "Op3::Run1", "v1", "data_.f3", "run1", "cpp"]


@sym_query(r"""+q AS (SELECT unnest(['op3', 'op3::run1', 'v1', 'data_.f3', 'run1', 'cpp']) AS needle, unnest(['op3', 'run1', 'v1', 'f3', 'run1', 'cpp']) AS tail),
n AS (SELECT needle, tail, id, kind, lower(name) AS low, string_split(replace(lower(name), '.', '::'), '::')[-1] AS ident, string_split(replace(replace(id, '/', '::'), '.', '::'), '::')[-1] AS of_id FROM sym, q),
t AS (SELECT needle, id, (CASE WHEN starts_with(low, needle || '::') OR starts_with(low, tail || '::') THEN 0 WHEN needle IN (low, ident, of_id) OR tail IN (ident, of_id) THEN CASE kind WHEN 'METHOD' THEN 1 ELSE 0 END
WHEN starts_with(low, needle) OR starts_with(ident, needle) THEN CASE WHEN (starts_with(low, needle) AND regexp_matches(substr(low, length(needle) + 1, 1), '[\p{L}\p{N}]')) OR (starts_with(ident, needle) AND regexp_matches(substr(ident, length(needle) + 1, 1), '[\p{L}\p{N}]')) THEN 3 ELSE 2 END
WHEN contains(low, needle) THEN 4 END)::INT AS tier FROM n) SELECT needle, id, tier FROM t WHERE tier IS NOT NULL""")
def tk2_name_tiers(spark, d):
    """The symbols that each wanted name fits, and how well."""
    s = src.symbols(spark, d)
    tier = lambda q: rank.match_tier(F.col("name"), F.col("id"), F.col("kind"), q)
    tiers = F.array(*(F.struct(F.lit(q.lower()).alias("needle"), tier(q).alias("tier")) for q in _WANTED))
    return s.select("id", F.explode(F.filter(tiers, lambda x: x["tier"].isNotNull())).alias("x")).select("x.needle", "id", "x.tier")


@code_query("""+f AS (SELECT DISTINCT path FROM code) SELECT 'missing_folder/OpKernel*' AS pattern, list_sort(list(path))[1:6] AS nearest FROM f WHERE contains(path, 'op_kernel') HAVING count(*) > 0
UNION ALL SELECT 'absent_name/**/ARCH-22/*.h', list_sort(list(path))[1:6] FROM f WHERE contains(path, 'arch22') HAVING count(*) > 0""")
def tx10_nearest_on_miss(spark, d):
    """Globs that select no file: the longest literal that any path holds decides, and a glob that selects files gives none."""
    files = src.code_lines(spark, d).select("path").distinct()
    return _union(text.nearest_paths(files, g) for g in ("missing_folder/OpKernel*", "absent_name/**/ARCH-22/*.h", "op_host/*"))


# -- sites, edges, joins --------------------------------------------------------------


@sym_query("SELECT DISTINCT symbol AS owner, path AS file, line::INT AS line, trim(rhs) AS rhs FROM wsym")
def af2_normal_sites(spark, d):
    """Write sites that arrive twice, in two spellings and with some lines unknown: each once."""
    w = src.writes(spark, d).select(names.normal_path(F.col("path")).alias("file"), "line", "rhs", F.regexp_replace("lhs", "^this->", "").alias("owner"))
    other = w.select("owner", F.replace("file", F.lit("/"), F.lit("\\")).alias("file"), "line", F.concat(F.lit("  "), "rhs", F.lit(" ")).alias("rhs"))
    return merge.normal_sites(_union([w, other, w.withColumn("line", F.lit(0))]))


@query("""SELECT p_partkey, ['AND', 'EQ', 'GT', 'OR', 'STRCMP'] AS operators, CASE p_size WHEN 16 THEN ['0', '16', 'FAST_MODE'] ELSE list_sort(list_distinct(['0', '16', p_size::VARCHAR, 'FAST_MODE'])) END AS literals,
['DT_FLOAT16', 'DT', 'FLOAT16', 'FAST_MODE'] AS enum_values, list_sort(['dtype', 'mode', 'n' || p_size]) AS "references", p_size > 9 AS wide FROM part""", graph=False)
def af3_predicate_accessors(spark, d):
    """The operators, literals, references and enumerators of parsed conditions."""
    size = F.col("p_size").cast("string")
    cond = F.concat(F.lit("dtype == ge::DT_FLOAT16 && (ctx.n"), size, F.lit(" > 0x10 || "), size, F.lit('u == 0 || strcmp(mode, "FAST_MODE") == 0)'))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 9).alias("wide"), predicates.parse_predicate(cond).alias("p"))
    return p.select("p_partkey", "wide", F.sort_array("p.operators").alias("operators"), F.sort_array("p.literals").alias("literals"), "p.enum_values", F.sort_array("p.references").alias("references"))


@query(f"WITH {_PROV} SELECT event_id, source, CASE source WHEN 'ast' THEN 'authoritative' WHEN 'dsl' THEN 'derived' ELSE 'advisory' END AS trust, CASE WHEN source IN ('ast', 'dsl') THEN 'resolved' ELSE 'candidate' END AS state FROM i WHERE source <> 'unspecified'", graph=False)
def rm3_minted_edges(spark, d):
    """Trust and state are given when an edge is made; sources that may mint none make none."""
    got = _provenances(spark, d).select("event_id", merge.inferred(F.col("provenance"))["source"].alias("source"))
    return got.withColumn("m", merge.minted(F.col("source"))).where("m IS NOT NULL").select("event_id", "source", "m.trust", "m.state")


@sym_query("SELECT e.dst AS field, e.src, f.name AS writer, f.line_start::INT AS line_start FROM sedge e LEFT JOIN (SELECT * FROM sym WHERE file LIKE 'op_host/%') f ON f.id = e.src WHERE e.kind = 'WRITES'")
def jn4_writes_with_writers(spark, d):
    """Every write, with its writer where the host's symbols hold it."""
    host = src.symbols(spark, d).where(F.col("file").startswith("op_host/")).select(F.col("id").alias("src"), F.col("name").alias("writer"), "line_start")
    return src.symbol_edges(spark, d).where("kind = 'WRITES'").join(host, "src", "left").select(F.col("dst").alias("field"), "src", "writer", "line_start")


@query("SELECT a.value AS type, b.value AS size, count(*)::BIGINT AS n FROM dim a JOIN dim b USING (key_id) WHERE a.dim = 'type' AND b.dim = 'size' AND key_id IN (SELECT key_id FROM dim WHERE dim = 'brand' AND value LIKE '%1') GROUP BY ALL")
def jn6_two_dim_grid(spark, d):
    """Counts of two dims' values over the keys that a third one selects."""
    dims = encode.key_dims(spark, d)
    chosen = dims.where((F.col("dim") == "brand") & F.col("value").endswith("1")).select("key_id")
    of = lambda x: dims.where(F.col("dim") == x).select("key_id", F.col("value").alias(x))
    return of("type").join(chosen, "key_id", "left_semi").join(of("size"), "key_id").groupBy("type", "size").agg(F.count(F.lit(1)).alias("n"))


@code_query("""+g AS (SELECT c.path, c.line, list(cond ORDER BY b.line_end - b.line_start, b.line_start DESC)[1:3] AS conds FROM (SELECT DISTINCT path, line FROM call) c JOIN guard b ON b.path = c.path AND c.line > b.line_start AND c.line <= b.line_end GROUP BY ALL)
SELECT path, line, function, callee, coalesce(conds, []) AS conds FROM call LEFT JOIN g USING (path, line)""")
def lc10_guards_of_calls(spark, d):
    """The conditions under which each call runs, innermost first; calls that always run have none."""
    calls = src.calls(spark, d)
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    around = intervals.innermost(calls.select("path", "line").distinct(), g, ["path", "line"])
    listed = around.groupBy("path", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "cond"))), lambda x: x["cond"]).alias("conds"))
    return calls.join(listed, ["path", "line"], "left").select("path", "line", "function", "callee", F.coalesce("conds", F.array().cast("array<string>")).alias("conds"))


# -- closures, sets -------------------------------------------------------------------


@sym_query("""+c AS (SELECT src, dst FROM sedge WHERE kind = 'CALLS'), w AS (SELECT id FROM sym WHERE kind = 'FUNCTION' AND name LIKE 'Op0::%' AND file LIKE 'op_host/%' UNION SELECT c.dst FROM w JOIN c ON c.src = w.id)
SELECT src, dst FROM c WHERE src IN (SELECT id FROM w)""", recursive=True)
def ps1_reachable_calls(spark, d):
    """Calls whose two ends the roots reach, to the fixpoint."""
    roots = src.functions(spark, d).where("function LIKE 'Op0::%' AND path LIKE 'op_host/%'").select(src.function_id().alias("id"))
    calls = src.call_edges(spark, d).select("src", "dst")
    live = traverse.reach(roots, calls).select(F.col("id").alias("src"))
    return calls.join(live, "src", "left_semi")


@query("""+m AS (SELECT 'PART:' || p_partkey AS dst, regexp_extract(p_name, '[^ ]*$') AS leaf, p_brand AS owner, p_size % 3 = 0 AS base FROM part), f AS (SELECT leaf, list(DISTINCT owner) FILTER (base) AS b, list(DISTINCT owner) FILTER (NOT base) AS o FROM m GROUP BY leaf)
SELECT leaf, len(b)::INT AS bases, len(o)::INT AS overrides, count(*)::BIGINT AS calls FROM rel JOIN m USING (dst) JOIN f USING (leaf) WHERE rel.kind = 'READS' AND b IS NOT NULL AND o IS NOT NULL AND len(list_distinct(list_concat(b, o))) > 1 GROUP BY ALL""")
def ps14_virtual_calls(spark, d):
    """How many uses each family of a base and its overrides has: every use of a member may reach any of them."""
    m = table(spark, d, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("dst"), F.element_at(F.split("p_name", " "), -1).alias("leaf"), F.col("p_brand").alias("owner"), "p_size")
    families = lineage.dispatch_families(m, "leaf", "owner", F.col("p_size") % 3 == 0).select("leaf", F.size("bases").alias("bases"), F.size("overrides").alias("overrides"))
    uses = encode.relations(spark, d).where("kind = 'READS'").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    used = uses.join(m.select("dst", "leaf"), "dst").groupBy("leaf").agg(F.sum("n").alias("calls"))
    return families.join(used, "leaf")


@query("""+one AS (SELECT kind, src, dst FROM rel WHERE src = 'NATION:3' OR dst = 'NATION:3'), ends AS (SELECT src AS id FROM one UNION SELECT dst FROM one)
SELECT DISTINCT kind, src, dst FROM rel WHERE (src IN (SELECT id FROM ends) OR dst IN (SELECT id FROM ends)) EXCEPT SELECT * FROM one""")
def set4_unseen_edges(spark, d):
    """What a walk's second hop finds that its first has not seen."""
    edges = encode.relations(spark, d).select("kind", "src", "dst")
    one = edges.where("src = 'NATION:3' OR dst = 'NATION:3'")
    ends = one.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    touching = _union(edges.join(ends.withColumnRenamed("id", side), side, "left_semi") for side in ("src", "dst"))
    return touching.distinct().join(one, ["kind", "src", "dst"], "left_anti")


@query("SELECT DISTINCT kind, file FROM ent")
def set5_distinct(spark, d):
    return encode.entities(spark, d).select("kind", "file").distinct()


# -- updates, pages -------------------------------------------------------------------

_NULLED = """WITH a AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 23 <> 0 THEN sha256(text) END AS sha FROM documents WHERE doc_id % 17 <> 0),
b AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 29 <> 0 THEN sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) END AS sha FROM documents WHERE doc_id % 19 <> 0)"""


@query(_NULLED + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha IS DISTINCT FROM b.sha", graph=False)
def upd2_changed_paths(spark, d):
    """Changed paths where some contents have no hash: those that have none on either side are unchanged."""
    old, new = _snapshots(spark, d)
    without = lambda frame, k: frame.withColumn("sha", F.when(F.col("path").cast("long") % k != 0, F.col("sha")))
    return audit.changed(without(old, 23), without(new, 29))


@query(_CHANGED.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT doc_id::VARCHAR AS src, (doc_id // 10)::VARCHAR AS dst FROM documents), w AS (SELECT path AS id FROM ch UNION SELECT e.src FROM w JOIN e ON e.dst = w.id)
SELECT id, id IN (SELECT path FROM ch) AS itself FROM w""", graph=False)
def upd3_affected_files(spark, d):
    """Changed files and all that include them, directly or not."""
    changed = audit.changed(*_snapshots(spark, d)).select(F.col("path").alias("id"))
    includes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src"), F.floor(F.col("doc_id") / 10).cast("string").alias("dst"))
    affected = traverse.propagate_flag(changed, includes).select("id")
    return affected.join(changed.withColumn("itself", F.lit(True)), "id", "left").select("id", F.coalesce("itself", F.lit(False)).alias("itself"))


@sym_query("SELECT id, (row_number() OVER (ORDER BY id))::INT AS position FROM sym ORDER BY id LIMIT 32 OFFSET 32")
def tk10_cursor_page(spark, d):
    """The page that a cursor of the first one leads to, bound to the snapshot and the request."""
    asked = rank.fingerprint({"operation": "search"})
    cursor = rank.Cursor.read(rank.Cursor(32, "s", asked).token(), "s", asked)
    got = rank.page(src.symbols(spark, d).select("id"), ["id"], 32, cursor.offset)
    return got.withColumn("position", F.row_number().over(Window.orderBy("id")) + cursor.offset)


@sym_query("""+s AS (SELECT kind, count(*) AS n, count(DISTINCT src) AS shown FROM sedge GROUP BY kind) SELECT kind, CASE WHEN n <= shown THEN kind || '  ' || n || ' of ' || n || ', complete' ELSE kind || '  ' || shown || ' of ' || n || ' shown' END AS head FROM s
UNION ALL SELECT 'NOTES', 'NOTES  not computed here'""")
def sv7_section_heads(spark, d):
    """Heads of sections that say whether they are whole, cut, or were not looked for."""
    s = src.symbol_edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("shown"))
    every = s.unionByName(spark.createDataFrame([("NOTES", None, None)], "kind string, n long, shown long"))
    return every.select("kind", cards.section_head(F.col("kind"), F.col("shown"), F.col("n")).alias("head"))


_TX1 = ORACLES["tx1_search_page"].removeprefix(f"WITH {src.SYM_SQL}").lstrip().removeprefix(",").lstrip()


@sym_query(f"""+hits AS (WITH {_TX1.replace('BETWEEN 21 AND 40', '<= 20')}) SELECT 'search' AS operation, path AS found, line::INT AS line, position::BIGINT AS n FROM hits
UNION ALL SELECT 'trace', src, first_line, n_sites FROM sedge WHERE kind = 'WRITES' AND dst = 'FIELD:data_.f3' UNION ALL SELECT 'source', path, line, 0 FROM code WHERE path = 'op_host/m0.cpp' AND line BETWEEN 3 AND 9""")
def sv2_typed_requests(spark, d):
    """A search, a trace and a source request, each answered by the operator it names; filters that are not known are dropped."""
    tables = {"lines": src.code_lines(spark, d), "symbols": src.symbols(spark, d), "edges": src.symbol_edges(spark, d)}
    ask = lambda operation, **filters: service.planned(tables, service.Request(operation, filters))
    search = ask("search", pattern="total[13]|Pick", file="op_kernel/**", colour="red").select(F.lit("search").alias("operation"), F.col("path").alias("found"), "line", F.col("position").cast("long").alias("n"))
    trace = ask("trace", symbol="data_.f3", relation="WRITES").select(F.lit("trace").alias("operation"), F.col("id").alias("found"), F.col("first_line").alias("line"), F.col("n_sites").alias("n"))
    source = ask("source", file="./op_host/m0.cpp", line=3, line_end=9).select(F.lit("source").alias("operation"), F.col("path").alias("found"), "line", F.lit(0).cast("long").alias("n"))
    return _union([search, trace, source])
