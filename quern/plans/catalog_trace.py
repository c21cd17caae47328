"""Registered queries, fourth part: traces with paths, closures, name cards, ranked search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import cards, gramindex, rank, text, traverse
from quern.plans import encode
from quern.plans import encode_code as src
from quern.plans.catalog import query, seed
from quern.plans.encode_code import SYM_SQL


def sym_query(sql: str = "", recursive: bool = False):
    return query(sql, base=SYM_SQL, recursive=recursive)


def _n(frame, *by):
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# -- traces ---------------------------------------------------------------------------

#: A walk with fan-out and node budget in closed form: nodes by (distance, id), of which the first are admitted.
_WALK = """fan AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY kind, dst) AS n FROM ({edges})) WHERE n <= {fanout}),
w AS ({start} UNION SELECT fan.dst, w.distance + 1, list_append(w.path, fan.dst) FROM w JOIN fan ON fan.src = w.id WHERE w.distance < {depth} AND NOT list_contains(w.path, fan.dst)),
best AS (SELECT id, min(distance) AS distance FROM w GROUP BY id),
walk AS (SELECT id, distance::INT AS distance, path FROM (SELECT w.id, w.distance, min(w.path) AS path FROM w JOIN best ON best.id = w.id AND best.distance = w.distance GROUP BY w.id, w.distance) ORDER BY distance, id LIMIT {budget})"""


@query("+" + _WALK.format(edges="SELECT kind, src, dst FROM rel", fanout=12, depth=4, budget=80, start="SELECT 'CUSTOMER:1' AS id, 0 AS distance, ['CUSTOMER:1'] AS path") + " SELECT id, distance, path FROM walk", recursive=True)
def gr13_bounded_trace(spark, d):
    """A walk of at most 80 nodes, 12 edges a node and 4 hops, with a shortest path to each node."""
    return traverse.bounded_walk(seed(spark, "CUSTOMER:1"), encode.relations(spark, d).select("kind", "src", "dst"), 4, 12, 80)


@query("+" + _WALK.format(edges="SELECT kind, src, dst FROM rel WHERE kind <> 'CALLS' UNION ALL SELECT kind, dst, src FROM rel WHERE kind <> 'CALLS'", fanout=1000000, depth=3, budget=80, start="SELECT 'ORDER:1' AS id, 0 AS distance, ['ORDER:1'] AS path") + """,
over AS (SELECT DISTINCT w.id FROM walk w JOIN (SELECT src, dst FROM rel WHERE kind = 'BINDS' UNION SELECT dst, src FROM rel WHERE kind = 'BINDS') e ON e.dst = w.id JOIN walk v ON v.id = e.src AND v.distance = w.distance - 1)
SELECT walk.id, walk.distance, (ent.kind = 'SUPPLIER' OR over.id IS NOT NULL) AS sink FROM walk JOIN ent ON ent.id = walk.id LEFT JOIN over ON over.id = walk.id""", recursive=True)
def gr12_impact_closure(spark, d):
    """What a change reaches in both directions, calls left out; sinks by kind or by the edge that reached them."""
    edges = traverse.symmetric(encode.relations(spark, d).where("kind <> 'CALLS'").select("kind", "src", "dst"))
    near = traverse.bounded_walk(seed(spark, "ORDER:1"), edges, 3, 1000000, 80).select("id", "distance")
    before = near.select(F.col("id").alias("src"), F.col("distance").alias("before"))
    over = edges.where("kind = 'BINDS'").join(before, "src").join(near.select(F.col("id").alias("dst"), "distance"), "dst").where("before = distance - 1").select(F.col("dst").alias("id"), F.lit(True).alias("over")).distinct()
    kinds = encode.entities(spark, d).select("id", "kind")
    return near.join(kinds, "id").join(over, "id", "left").select("id", "distance", ((F.col("kind") == "SUPPLIER") | F.coalesce("over", F.lit(False))).alias("sink"))


#: Families of a trace in the order their paths are preferred, with the kinds, depth and node budget of each.
TRACE_FAMILIES = [("call", ["CALLS"], 5, 80), ("write", ["BINDS"], 5, 80), ("read", ["READS"], 5, 80), ("path", ["CALLS", "READS", "BINDS"], 5, 80), ("compile", ["CONTAINS"], 3, 40)]


def _family_sql(start: str) -> str:
    parts = []
    for i, (family, kinds, depth, budget) in enumerate(TRACE_FAMILIES):
        listed = ", ".join(f"'{k}'" for k in kinds)
        body = _WALK.format(edges=f"SELECT kind, src, dst FROM rel WHERE kind IN ({listed})", fanout=12, depth=depth, budget=budget, start=f"SELECT '{start}' AS id, 0 AS distance, ['{start}'] AS path")
        for name in ("fan", "best", "walk", "w"):
            body = body.replace(f"{name} AS (", f"{name}{i} AS (").replace(f" {name} ", f" {name}{i} ").replace(f"{name}.", f"{name}{i}.")
        parts.append((i, family, body))
    found = " UNION ALL ".join(f"SELECT id, distance, path, {i} AS ord, '{f}' AS family FROM walk{i} WHERE distance > 0" for i, f, _ in parts)
    spent = " OR ".join(f"(SELECT count(*) FROM walk{i}) >= {TRACE_FAMILIES[i][3]} OR EXISTS (SELECT 1 FROM walk{i} JOIN fan{i} ON fan{i}.src = walk{i}.id WHERE distance = {TRACE_FAMILIES[i][2]})" for i, _, _ in parts)
    return ", ".join(b for _, _, b in parts) + f""", found AS ({found}), top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r, count(*) OVER (PARTITION BY id) AS families FROM found)
SELECT ent.id, CASE WHEN top.id IS NOT NULL THEN 'COMPLETE' WHEN {spent} THEN 'SEARCH_BUDGET' ELSE 'NO_PATH' END AS status, top.family, top.distance AS hops, top.path, coalesce(families, 0)::BIGINT AS families
FROM ent LEFT JOIN top ON top.id = ent.id AND top.r = 1 WHERE ent.kind IN ('ORDER', 'PART', 'SUPPLIER', 'NATION')"""


@query("+" + _family_sql("CUSTOMER:1"), recursive=True)
def gr14_family_paths(spark, d):
    """To every entity of four kinds: the best family's shortest path, how many families have one, or why none has."""
    wanted = encode.entities(spark, d).where("kind IN ('ORDER', 'PART', 'SUPPLIER', 'NATION')").select("id")
    return traverse.family_paths(seed(spark, "CUSTOMER:1"), wanted, encode.relations(spark, d), TRACE_FAMILIES, 12)


_NEAR = "e AS ({edges}), w AS (SELECT id, 0 AS distance FROM sym WHERE kind = 'FUNCTION' AND regexp_extract(name, '\\w+$') = 'Run65' UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.id WHERE w.distance < {depth})"


@sym_query("+" + _NEAR.format(edges="SELECT src, dst FROM sedge", depth=6) + " SELECT id, min(distance)::INT AS distance FROM w GROUP BY id ORDER BY distance, id LIMIT 50", recursive=True)
def gr15_influence(spark, d):
    """Up to 50 symbols that the functions of a name lead to, nearest first."""
    starts = src.symbols(spark, d).where((F.col("kind") == "FUNCTION") & (names.leaf(F.col("name")) == "Run65")).select("id")
    return traverse.bounded_walk(starts, src.symbol_edges(spark, d).select("kind", "src", "dst"), 6, 1000000, 50).select("id", "distance")


@sym_query("+" + _NEAR.format(edges="SELECT dst AS src, src AS dst FROM sedge WHERE kind = 'CALLS'", depth=6) + " SELECT id, min(distance)::INT AS distance FROM w GROUP BY id ORDER BY distance, id LIMIT 50", recursive=True)
def gr16_upstream(spark, d):
    """Up to 50 transitive callers of a name."""
    starts = src.symbols(spark, d).where((F.col("kind") == "FUNCTION") & (names.leaf(F.col("name")) == "Run65")).select("id")
    back = src.symbol_edges(spark, d).where("kind = 'CALLS'").select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traverse.bounded_walk(starts, back, 6, 1000000, 50).select("id", "distance")


_CATEGORY = "CASE WHEN starts_with(callee, 'Get') THEN 'read' WHEN starts_with(callee, 'set_') OR callee = 'Set' THEN 'write' WHEN callee = 'OP_CHECK' THEN 'check' WHEN starts_with(callee, 'Run') THEN 'call' ELSE 'compute' END"


def _category(callee):
    return F.when(callee.startswith("Get"), "read").when(callee.startswith("set_") | (callee == "Set"), "write").when(callee == "OP_CHECK", "check").when(callee.startswith("Run"), "call").otherwise("compute")


@sym_query(f"+op AS (SELECT 'FUNCTION:' || function || '@' || path AS id, {_CATEGORY} AS category FROM call) SELECT e.src AS id, op.category, count(*)::BIGINT AS n FROM (SELECT DISTINCT src, dst FROM sedge WHERE kind = 'CALLS') e JOIN op ON op.id = e.dst GROUP BY ALL")
def gr20_delegated_operations(spark, d):
    """What the functions called by each function do, by category."""
    ops = _n(src.calls(spark, d).select(src.function_id().alias("dst"), _category(F.col("callee")).alias("category")), "dst", "category")
    called = src.symbol_edges(spark, d).where("kind = 'CALLS'").select("src", "dst").distinct()
    return called.join(ops, "dst").groupBy(F.col("src").alias("id"), "category").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT r.id, e.id AS other, e.kind FROM (SELECT src AS id, dst AS other, kind FROM rel UNION ALL SELECT dst, src, kind FROM rel) r JOIN ent e ON e.id = r.other WHERE r.id LIKE 'PART:%' AND (r.kind IN ('BINDS', 'CONTAINS') OR e.kind IN ('CUSTOMER', 'REGION'))")
def gr22_controllability(spark, d):
    """For each part, what controls it: by the edge's kind or by the neighbour's."""
    r = traverse.symmetric(encode.relations(spark, d).select("kind", "src", "dst")).where(F.col("src").startswith("PART:"))
    e = encode.entities(spark, d).select(F.col("id").alias("dst"), F.col("kind").alias("other_kind"))
    hit = r.join(e, "dst").where(F.col("kind").isin("BINDS", "CONTAINS") | F.col("other_kind").isin("CUSTOMER", "REGION"))
    return hit.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("other_kind").alias("kind")).distinct()


@query("SELECT src AS id, dst AS kernel, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst)::INT AS rank FROM (SELECT DISTINCT r.src, r.dst FROM rel r JOIN ent e ON e.id = r.dst WHERE r.kind IN ('READS', 'BINDS') AND e.kind = 'SUPPLIER')) WHERE rank <= 40")
def gr24_selected_targets(spark, d):
    """Up to 40 targets of one kind that each key selects."""
    e = encode.entities(spark, d).where("kind = 'SUPPLIER'").select(F.col("id").alias("dst"))
    r = encode.relations(spark, d).where("kind IN ('READS', 'BINDS')").join(e, "dst", "left_semi").select("src", "dst").distinct()
    return traverse.top_per(r, ["src"], ["dst"], 40).select(F.col("src").alias("id"), F.col("dst").alias("kernel"), "rank")


@query("+w AS (SELECT id FROM ent WHERE kind = 'REGION' UNION SELECT rel.dst FROM w JOIN rel ON rel.src = w.id) SELECT kind, count(*)::BIGINT AS total, count(w.id)::BIGINT AS rooted FROM ent LEFT JOIN (SELECT DISTINCT id FROM w) w USING (id) GROUP BY kind", recursive=True)
def gr31_rooted_evidence(spark, d):
    """Per kind, how many entities a source root leads to."""
    roots = encode.entities(spark, d).where("kind = 'REGION'").select("id")
    rooted = traverse.reach(roots, encode.relations(spark, d)).select("id", F.lit(1).alias("rooted"))
    return encode.entities(spark, d).join(rooted, "id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count("rooted").alias("rooted"))


@sym_query("SELECT dst AS id, count(*) FILTER (kind = 'CALLS')::BIGINT AS callers, count(*) FILTER (kind = 'WRITES')::BIGINT AS writers, count(*) FILTER (kind = 'READS')::BIGINT AS readers, count(*)::BIGINT AS refs FROM sedge GROUP BY dst")
def gr17_callers_writers_readers(spark, d):
    by = lambda k: F.count_if(F.col("kind") == k)
    return src.symbol_edges(spark, d).groupBy(F.col("dst").alias("id")).agg(by("CALLS").alias("callers"), by("WRITES").alias("writers"), by("READS").alias("readers"), F.count(F.lit(1)).alias("refs"))


# -- aggregation over symbols ---------------------------------------------------------


@sym_query("""SELECT cond AS name, coalesce(function, '') AS function, CASE WHEN path LIKE '%/common/%' THEN 2 WHEN path LIKE 'op_host/%' THEN 0 ELSE 1 END::INT AS layer, count(*)::BIGINT AS n, list_sort(list(DISTINCT path || ':' || line_start)) AS sites
FROM (SELECT g.*, s.function FROM guard g JOIN scan s ON s.path = g.path AND s.line = g.line_start) GROUP BY ALL""")
def ag17_folded_branches(spark, d):
    """Branches of the same text, function and layer as one row with all their sites."""
    named = src.guards(spark, d).join(src.scanned(spark, d).select("path", F.col("line").alias("line_start"), "function"), ["path", "line_start"])
    site = F.concat("path", F.lit(":"), F.col("line_start").cast("string"))
    return named.groupBy(F.col("cond").alias("name"), F.coalesce("function", F.lit("")).alias("function"), names.path_layer(F.col("path")).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(site)).alias("sites"))


@sym_query("""SELECT f.name AS field, count(DISTINCT e.src) FILTER (e.kind = 'WRITES')::BIGINT AS writers, count(DISTINCT e.src) FILTER (e.kind = 'READS' AND e.src LIKE '%@op_kernel/%')::BIGINT AS kernel_readers,
min(e.src) FILTER (e.kind = 'WRITES') AS first_writer FROM sym f LEFT JOIN sedge e ON e.dst = f.id WHERE f.kind = 'FIELD' GROUP BY f.name""")
def ag29_field_map(spark, d):
    """Per field, who writes it and which kernel functions read it."""
    f = src.symbols(spark, d).where("kind = 'FIELD'").select(F.col("id").alias("dst"), F.col("name").alias("field"))
    writes, kernel = F.col("kind") == "WRITES", (F.col("kind") == "READS") & F.col("src").contains("@op_kernel/")
    got = src.symbol_edges(spark, d).groupBy("dst").agg(F.count_if(writes).alias("writers"), F.count_if(kernel).alias("kernel_readers"), F.min(F.when(writes, F.col("src"))).alias("first_writer"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return f.join(got, "dst", "left").select("field", zero("writers"), zero("kernel_readers"), "first_writer")


@sym_query("""+x AS (SELECT f.name, e.kind, e.src, e.n_sites, e.first_line FROM sym f LEFT JOIN sedge e ON e.dst = f.id WHERE f.kind = 'FIELD')
SELECT name, count(*) FILTER (kind = 'WRITES')::BIGINT AS writers, count(*) FILTER (kind = 'READS')::BIGINT AS readers, coalesce(sum(n_sites) FILTER (kind = 'WRITES'), 0)::BIGINT AS write_sites,
(arg_min(src, (-n_sites, src)) FILTER (kind = 'WRITES')) AS best_writer, CASE WHEN count(*) FILTER (kind = 'WRITES') > 0 AND count(*) FILTER (kind = 'READS') > 0 THEN 'both' WHEN count(*) FILTER (kind = 'WRITES') > 0 THEN 'write_only' ELSE 'none' END AS coverage FROM x GROUP BY name""")
def ag28_field_impact_card(spark, d):
    """Writers, readers and the writer with the most sites of every field."""
    f = src.symbols(spark, d).where("kind = 'FIELD'").select(F.col("id").alias("dst"), "name")
    return cards.field_impact(f, src.symbol_edges(spark, d))


# -- windows and ranks ----------------------------------------------------------------


@query("SELECT id, kind, other, name, rank FROM (SELECT r.src AS id, r.kind, e.id AS other, e.name, row_number() OVER (PARTITION BY r.src, r.kind ORDER BY CASE r.trust WHEN 'authoritative' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, e.kind, e.name, e.id)::INT AS rank FROM rel r JOIN ent e ON e.id = r.dst) WHERE rank <= 64")
def wn1_top_relations(spark, d):
    """Up to 64 neighbours per relation kind, best evidence first."""
    e = encode.entities(spark, d).select(F.col("id").alias("dst"), F.col("kind").alias("other_kind"), "name")
    order = F.when(F.col("trust") == "authoritative", 0).when(F.col("trust") == "derived", 1).otherwise(2)
    r = encode.relations(spark, d).join(e, "dst")
    return traverse.top_per(r, ["src", "kind"], [order, "other_kind", "name", "dst"], 64).select(F.col("src").alias("id"), "kind", F.col("dst").alias("other"), "name", "rank")


@query("""+n AS (SELECT r.src, r.kind, e.kind AS ek, e.name, min(CASE r.trust WHEN 'authoritative' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END) AS ev FROM rel r JOIN ent e ON e.id = r.dst GROUP BY ALL)
SELECT src, kind, name, rank FROM (SELECT src, kind, name, row_number() OVER (PARTITION BY src, kind ORDER BY ev, ek, name)::INT AS rank FROM n) WHERE rank <= CASE kind WHEN 'BINDS' THEN 3 ELSE 8 END""")
def wn2_capped_relations(spark, d):
    """Neighbours distinct by kind and name, by evidence, at most eight per relation kind and three of one kind."""
    e = encode.entities(spark, d).select(F.col("id").alias("dst"), F.col("kind").alias("ek"), "name")
    ev = F.when(F.col("trust") == "authoritative", 0).when(F.col("trust") == "derived", 1).otherwise(2)
    n = encode.relations(spark, d).join(e, "dst").groupBy("src", "kind", "ek", "name").agg(F.min(ev).alias("ev"))
    top = traverse.top_per(n, ["src", "kind"], ["ev", "ek", "name"], 8)
    return top.where(F.col("rank") <= F.when(F.col("kind") == "BINDS", 3).otherwise(8)).select("src", "kind", "name", "rank")


@query("""+e AS (SELECT DISTINCT src, dst FROM rel WHERE kind IN ('CONTAINS', 'CALLS')),
w AS (SELECT DISTINCT src AS id, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id), l AS (SELECT id, max(level)::INT AS level FROM w GROUP BY id)
SELECT id, level, row_number() OVER (PARTITION BY level, kind ORDER BY line_start, name, id)::INT AS position FROM l JOIN ent USING (id)""", recursive=True)
def wn8_lifetime_order(spark, d):
    """Entities in the order of their topological level, and by line and name within it, per kind."""
    levels = traverse.topo_levels(encode.relations(spark, d).where("kind IN ('CONTAINS', 'CALLS')"))
    placed = rank.positions(levels.join(encode.entities(spark, d).select("id", "kind", "line_start", "name"), "id"), ["level", "kind"], ["line_start", "name", "id"])
    return placed.select("id", "level", "position")


_LAYER = "CASE WHEN file LIKE '%/common/%' THEN 2 WHEN file LIKE 'op_host/%' THEN 0 WHEN file LIKE 'op_kernel/%' THEN 1 ELSE 3 END"


@sym_query(r"""+h AS (SELECT id, kind, name, file, line_start, lower(name) AS low, lower(regexp_extract(name, '\w+$')) AS leaf FROM sym),
m AS (SELECT *, CASE WHEN low = 'run1' OR leaf = 'run1' THEN 0 WHEN starts_with(low, 'run1') OR starts_with(leaf, 'run1') THEN 3 WHEN contains(low, 'run1') THEN 4 END AS tier, CASE WHEN starts_with(name, 'Op3::') THEN 0 ELSE 1 END AS owner,
CASE WHEN kind = 'FIELD' THEN 0 WHEN file <> '' THEN 1 ELSE 2 END AS occupancy, CASE kind WHEN 'FUNCTION' THEN 0 WHEN 'FIELD' THEN 1 ELSE 2 END AS priority, CASE WHEN file LIKE '%/common/%' THEN 3 WHEN file LIKE '%/arch35/%' THEN 0 WHEN file LIKE 'op_%' THEN 1 ELSE 2 END AS arch FROM h)
SELECT id, owner::INT AS owner, tier::INT AS tier, arch::INT AS arch, row_number() OVER (ORDER BY owner, tier, occupancy, priority, arch, line_start, id)::INT AS position FROM m WHERE tier IS NOT NULL""")
def tk1_ranked_hits(spark, d):
    """Hits of a qualified name in their total order: owner, match, occupancy, kind, architecture, line, id."""
    hits = rank.agent_ranked(src.symbols(spark, d), "Op3::Run1", "arch35")
    return hits.select("id", "owner", "tier", "arch", "position")


@sym_query(rf"""+t AS (SELECT id, kind, lower(regexp_extract(name, '\w+$')) AS leaf, lower(name) AS low, file, line_start FROM sym), n AS (SELECT count(*) AS n FROM sym), df AS (SELECT leaf, count(*) AS df FROM t GROUP BY leaf),
s AS (SELECT id, (CASE WHEN leaf = 'flag1' THEN 100 WHEN list_contains(regexp_extract_all(leaf, '[a-z]+|\d+'), 'flag1') THEN 75 ELSE 50 END) + (CASE WHEN file = '' THEN -20 WHEN file LIKE '%/common/%' THEN -10 WHEN file LIKE 'op_host/%' OR file LIKE 'op_kernel/%' THEN 20 ELSE 0 END)
+ (CASE kind WHEN 'FIELD' THEN 8 WHEN 'FUNCTION' THEN 2 ELSE 0 END) + 4 * ln((n + 1) / df) + (CASE WHEN df > greatest(3, n * 0.02) AND length(leaf) <= 8 THEN -15 ELSE 0 END) + (CASE WHEN file <> '' AND line_start > 0 THEN 4 ELSE 0 END) AS score,
leaf = 'flag1' AS exact FROM t JOIN df USING (leaf), n WHERE contains(low, 'flag1') OR contains(low, 'cap1'))
SELECT id, round(score, 4) AS score FROM s WHERE exact OR NOT (SELECT coalesce(bool_or(exact), false) FROM s)""")
def tk3_scored_names(spark, d):
    """Name discovery: match, place, salience, rarity, and whether the name is generic or located; exact ones alone if any."""
    return rank.discovered(src.symbols(spark, d), ["flag1", "cap1"])


@sym_query(rf"""SELECT path, line, (CASE WHEN starts_with(trim(text), '//') THEN 4 WHEN regexp_matches(trim(text), '^(if|for|while|switch)\b') THEN 2 WHEN regexp_matches(text, 'this->\w|\bset_\w+\(') THEN 0 WHEN regexp_matches(trim(text), '^(void|template|class|struct|enum|using|typedef)\b') THEN 0
WHEN regexp_matches(text, '\w\s*\+?=[^=]') THEN 1 ELSE 3 END)::INT AS role, (CASE WHEN regexp_matches(text, '\bsize1\b') THEN 0 ELSE 1 END)::INT AS tightness, ({_LAYER.replace("file", "path")})::INT AS layer,
row_number() OVER (PARTITION BY path ORDER BY line)::INT AS turn FROM code WHERE contains(text, 'size1')""")
def tk4_ranked_lines(spark, d):
    """Lines that hold a name by role, whole word, layer, path and line; ``turn`` counts the hits of a file."""
    hits = text.matching(src.code_lines(spark, d), "size1")
    shown = text.ranked_source(hits, "size1")
    return shown.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("line"))).select("path", "line", "role", "tightness", "layer", "turn")


@sym_query("""+h AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS turn, min(line) OVER (PARTITION BY path) AS first FROM code WHERE contains(text, 'Pick(size1,'))
SELECT path, line, position FROM (SELECT path, line, row_number() OVER (ORDER BY turn, first, path)::INT AS position FROM h) WHERE position <= 32""")
def tk6_interleaved_page(spark, d):
    """The first page of hits taken from the files by turns."""
    hits = src.code_lines(spark, d).where(F.col("text").contains("Pick(size1,")).select("path", "line")
    return rank.interleaved(hits, "path", ["line"], 32)


@sym_query("""+b AS (SELECT c.path, f.function, c.line, length(c.text) + 1 AS n, CASE WHEN c.line BETWEEN f.line_start AND f.line_end THEN 0 ELSE 1 END AS part FROM fn f JOIN code c ON c.path = f.path AND c.line BETWEEN f.line_start - 4 AND f.line_end + 4),
s AS (SELECT *, sum(n) OVER (PARTITION BY path, function ORDER BY part, line) AS upto FROM b)
SELECT path, function, count(*) FILTER (upto <= 400)::BIGINT AS kept, count(*) FILTER (upto > 400)::BIGINT AS trimmed, coalesce(bool_or(upto > 400 AND part = 0), false) AS body_cut FROM s GROUP BY path, function""")
def tk12_fitted_cards(spark, d):
    """Each function's body and four lines of context on both sides, fitted to 400 characters: context goes before body."""
    f = src.functions(spark, d)
    # Met by file: a list of wanted lines would be taken for as small as the functions and sent whole to every task.
    lines = f.join(src.code_lines(spark, d).hint("merge"), "path").where(F.col("line").between(F.col("line_start") - 4, F.col("line_end") + 4))
    part = F.when(F.col("line").between(F.col("line_start"), F.col("line_end")), 0).otherwise(1)
    return cards.fitted(lines.withColumn("part", part), ["path", "function"], 400)


@sym_query("""+c AS (SELECT DISTINCT path, function, callee FROM call), n AS (SELECT path, count(*) AS n FROM fn GROUP BY path) SELECT c.path, callee FROM c JOIN n USING (path) GROUP BY c.path, callee, n HAVING count(DISTINCT function) = n""")
def set6_common_to_all(spark, d):
    """Names that all functions of a file call."""
    c = src.calls(spark, d).select("path", "function", "callee").distinct()
    n = _n(src.functions(spark, d), "path").withColumnRenamed("n", "all")
    return c.groupBy("path", "callee").agg(F.count(F.lit(1)).alias("k")).join(n, "path").where("k = all").select("path", "callee")


# -- search and names -----------------------------------------------------------------


@sym_query(rf"""+h AS (SELECT path, line, (CASE WHEN starts_with(trim(text), '//') THEN 4 WHEN regexp_matches(trim(text), '^(if|for|while|switch)\b') THEN 2 WHEN regexp_matches(text, 'this->\w|\bset_\w+\(') THEN 0 WHEN regexp_matches(trim(text), '^(void|template|class|struct|enum|using|typedef)\b') THEN 0
WHEN regexp_matches(text, '\w\s*\+?=[^=]') THEN 1 ELSE 3 END) AS role, ({_LAYER.replace("file", "path")}) AS layer FROM code WHERE regexp_matches(text, 'total[13]|Pick') AND path LIKE 'op_kernel/%')
SELECT path, line, role::INT AS role, total, position FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY role, CASE WHEN true THEN 1 END, layer, path, line)::INT AS position FROM h) WHERE position BETWEEN 21 AND 40""")
def tx1_search_page(spark, d):
    """The second page of a regex search in kernel files, with the exact total."""
    found = gramindex.search(src.code_lines(spark, d), src.code_trigrams(spark, d), "total[13]|Pick", file="op_kernel/**")
    return text.search(found, "total[13]|Pick", limit=20, offset=20).select("path", "line", "role", "total", "position")


_PATTERNS = [r"set_f1\d?\(v", r"buf[2-4]\.Set\((v1|v2)\d", r"CAP\d+ 7$", r"(?i)op_check\(V1 ", r"\bn\d{3}\b", r"x+"]


@sym_query("+q AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PATTERNS) + "]) AS pattern) SELECT pattern, path, count(*)::BIGINT AS n, min(line) AS first FROM q JOIN code ON regexp_matches(text, pattern) GROUP BY ALL")
def tx3_indexed_patterns(spark, d):
    """Hits by file of several patterns, each met through the grams its syntax proves; the last proves none."""
    found = [gramindex.search(src.code_lines(spark, d), src.code_trigrams(spark, d), p).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).select(F.lit(p).alias("pattern"), "*") for p in _PATTERNS]
    return reduce(DataFrame.unionByName, found)


@sym_query("+lex AS (SELECT * FROM (VALUES ('validation', 'OP_CHECK'), ('buffer write', '.Set('), ('accumulate', '+='), ('setter', 'set_')) t(phrase, token)) SELECT phrase, token, (SELECT count(*) FROM code WHERE contains(text, token))::BIGINT AS n FROM lex WHERE contains('show me the validation and every setter', phrase)")
def tx8_lexicon_suggestions(spark, d):
    """For a question in words: the source tokens that its known phrases stand for, with their own line counts."""
    from quern.plans.catalog_code import LEXICON

    asked = [(p, t) for p, t in LEXICON if p in "show me the validation and every setter"]
    counted = src.code_lines(spark, d).agg(*(F.count_if(F.col("text").contains(t)).alias(f"n{i}") for i, (_, t) in enumerate(asked)))
    rows = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(t).alias("token"), F.col(f"n{i}").alias("n")) for i, (p, t) in enumerate(asked)))
    return counted.select(F.explode(rows).alias("x")).select("x.*")


@sym_query(r"""+q AS (SELECT * FROM (VALUES ('Op3::Run24'), ('Run24'), ('flag1'), ('Run2'), ('otal'), ('nothing')) t(needle)),
e AS (SELECT needle, id, name, CASE WHEN lower(name) = lower(needle) OR lower(regexp_extract(name, '\w+$')) = lower(needle) THEN 0 WHEN starts_with(lower(name), lower(needle)) OR starts_with(lower(regexp_extract(name, '\w+$')), lower(needle)) THEN 1 WHEN contains(lower(name), lower(needle)) THEN 2 END AS stage FROM q, sym),
b AS (SELECT needle, min(stage) AS best FROM e GROUP BY needle)
SELECT needle, CASE best WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'recall' ELSE 'none' END AS stage, (SELECT count(*) FROM e WHERE e.needle = b.needle AND e.stage = best)::BIGINT AS n, (SELECT min(id) FROM e WHERE e.needle = b.needle AND e.stage = best) AS first,
(SELECT count(DISTINCT regexp_extract(name, '^(\w+)::', 1)) FROM e WHERE e.needle = b.needle AND e.stage = best) > 1 AS ambiguous FROM b""")
def nm1_name_cards(spark, d):
    """For each needle, the first stage of exact, prefix and substring that finds anything, and whether several owners hold it."""
    asked = spark.createDataFrame([(x,) for x in ("Op3::Run24", "Run24", "flag1", "Run2", "otal", "nothing")], "needle string")
    return cards.name_cards(asked, src.symbols(spark, d))


@sym_query(r"SELECT kind, count(*) FILTER (lower(regexp_extract(name, '\w+$')) = 'run24')::BIGINT AS exact, count(*) FILTER (starts_with(lower(regexp_extract(name, '\w+$')), 'run24'))::BIGINT AS prefix FROM sym GROUP BY kind")
def nm2_hits_by_kind(spark, d):
    low = F.lower(names.leaf(F.col("name")))
    return src.symbols(spark, d).groupBy("kind").agg(F.count_if(low == "run24").alias("exact"), F.count_if(low.startswith("run24")).alias("prefix"))


@sym_query(r"SELECT id, (CASE WHEN regexp_extract(name, '^(\w+)::', 1) = 'Op3' THEN 0 ELSE 1 END)::INT AS owner_rank FROM sym WHERE kind = 'FUNCTION' AND regexp_matches(regexp_extract(name, '\w+$'), '^Run1\d$')")
def nm3_owner_rank(spark, d):
    """Members of the named owner before all others of the same leaf."""
    f = src.symbols(spark, d).where((F.col("kind") == "FUNCTION") & names.leaf(F.col("name")).rlike(r"^Run1\d$"))
    return f.select("id", rank.owner_rank(F.col("name"), "Op3").alias("owner_rank"))


@sym_query(r"SELECT leaf, count(DISTINCT owner)::BIGINT AS scopes, count(DISTINCT owner) > 1 AS ambiguous FROM (SELECT regexp_extract(name, '\w+$') AS leaf, CASE kind WHEN 'FUNCTION' THEN regexp_extract(name, '^(\w+)::', 1) ELSE file END AS owner FROM sym) GROUP BY leaf")
def nm4_ambiguity(spark, d):
    """Names by the number of scopes that hold them."""
    owner = F.when(F.col("kind") == "FUNCTION", F.split_part("name", F.lit("::"), F.lit(1))).otherwise(F.col("file"))
    g = src.symbols(spark, d).groupBy(names.leaf(F.col("name")).alias("leaf")).agg(F.count_distinct(owner).alias("scopes"))
    return g.withColumn("ambiguous", F.col("scopes") > 1)


@sym_query("""SELECT f.path, f.function, (SELECT count(*) FROM wr w WHERE w.path = f.path AND w.function = f.function)::BIGINT AS assignments, (SELECT count(*) FROM guard g WHERE g.path = f.path AND g.line_start BETWEEN f.line_start AND f.line_end)::BIGINT AS controls,
(SELECT count(*) FROM clean c WHERE c.path = f.path AND c.function = f.function AND contains(c.text, 'buf'))::BIGINT AS storage, (SELECT count(*) FROM sedge e WHERE e.kind = 'CALLS' AND e.dst = 'FUNCTION:' || f.function || '@' || f.path)::BIGINT AS used_by FROM fn f""")
def nm5_card_facets(spark, d):
    """Assignments, controls, storage and users of every function."""
    keys, f = ["path", "function"], src.functions(spark, d)
    n = lambda frame, name: frame.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    guards = src.guards(spark, d).select("path", F.col("line_start").alias("line")).join(src.scanned(spark, d).select("path", "line", "function"), ["path", "line"])
    users = src.symbol_edges(spark, d).where("kind = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("used_by"))
    out = f.withColumn("id", src.function_id()).join(n(src.writes(spark, d), "assignments"), keys, "left").join(n(guards, "controls"), keys, "left")
    out = out.join(n(src.bodies(spark, d).where(F.col("text").contains("buf")), "storage"), keys, "left").join(users, "id", "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("assignments", "controls", "storage", "used_by")))


@sym_query("""SELECT f.id, coalesce((SELECT list_sort(list(DISTINCT s.path || ':' || s.line)) FROM site2 s WHERE s.kind = 'WRITES' AND s.dst = f.id), [f.file || ':' || f.line_start]) AS sites FROM sym f""")
def nm6_symbol_bundle(spark, d):
    """Every symbol's write sites, or its own place where it has none."""
    site = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    written = src.symbol_sites(spark, d).where("kind = 'WRITES'").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(site)).alias("sites"))
    own = F.array(F.concat("file", F.lit(":"), F.col("line_start").cast("string")))
    return src.symbols(spark, d).join(written, "id", "left").select("id", F.coalesce("sites", own).alias("sites"))


@sym_query(r"""+b AS (SELECT path, line, function, regexp_extract(text, '\b(buf\d+)\.', 1) AS buffer FROM clean WHERE regexp_matches(text, '\bbuf\d+\.')) SELECT buffer, path, line, (row_number() OVER (PARTITION BY buffer ORDER BY path, line))::INT AS position FROM b""")
def nm7_resource_layout(spark, d):
    """Each buffer's uses in source order."""
    b = src.bodies(spark, d).where(F.col("text").rlike(r"\bbuf\d+\.")).select("path", "line", F.regexp_extract("text", r"\b(buf\d+)\.", 1).alias("buffer"))
    return rank.positions(b, ["buffer"], ["path", "line"])


@sym_query("""+x AS (SELECT f.name, count(*) FILTER (e.kind = 'WRITES') AS producers, count(*) FILTER (e.kind = 'READS') AS consumers, count(*) FILTER (e.kind = 'READS' AND e.src LIKE '%@op_kernel/%') AS sinks, count(*) FILTER (e.kind = 'WRITES' AND e.src LIKE '%@op_host/%') AS hosted FROM sym f LEFT JOIN sedge e ON e.dst = f.id WHERE f.kind = 'FIELD' GROUP BY f.name),
c AS (SELECT name, producers > 0 AS c1, true AS c2, hosted > 0 AS c3, consumers + sinks > 0 AS c6, sinks > 0 AS c7 FROM x)
SELECT name, CASE WHEN c1 AND c2 AND c3 AND c6 AND (NOT c6 OR c7) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS state, list_filter([CASE WHEN NOT c1 THEN 'NO_PRODUCER' END, CASE WHEN NOT c2 THEN 'PRODUCER_NOT_LOCATED' END, CASE WHEN NOT c3 THEN 'NO_TRANSPORT' END, CASE WHEN NOT c6 THEN 'NO_SINK' END, CASE WHEN c6 AND NOT c7 THEN 'CONSUMER_NOT_LOCATED' END], lambda r: r IS NOT NULL) AS reasons FROM c""")
def nm8_contract_cards(spark, d):
    """Whether each field's contract is complete: produced, located, carried from the host, and consumed by a located reader."""
    f = src.symbols(spark, d).where("kind = 'FIELD'").select(F.col("id").alias("dst"), "name")
    located = src.symbols(spark, d).where("file <> '' AND line_start > 0").select("id")
    return cards.contracts(f, src.symbol_edges(spark, d), located)


@sym_query(r"""SELECT s.id FROM sym s JOIN guard g ON false UNION ALL SELECT s.id FROM sym s WHERE s.kind = 'FUNCTION' AND s.file LIKE 'op_kernel/%' AND s.name LIKE 'Op3::%' AND EXISTS (SELECT 1 FROM call c WHERE 'FUNCTION:' || c.function || '@' || c.path = s.id AND lower(c.callee) = 'op_check')
AND EXISTS (SELECT 1 FROM wr w WHERE 'FUNCTION:' || w.function || '@' || w.path = s.id AND regexp_matches(w.rhs, '\bsize1\d*\b'))""")
def nm9_find(spark, d):
    """Functions by kind, layer, owner, callee and a symbol their assignments refer to, all at once."""
    wanted, keys = "path LIKE 'op_kernel/%' AND function LIKE 'Op3::%'", ["path", "function"]
    calls = src.calls(spark, d).where(wanted).where(F.lower("callee") == "op_check")
    refs = src.writes(spark, d).where(wanted).where(F.exists(names.identifiers(F.col("rhs")), lambda x: x.rlike(r"^size1\d*$")))
    found = F.bool_or(F.col("of") == "call") & F.bool_or(F.col("of") == "ref")
    tagged = [rows.select(*keys, F.lit(of).alias("of")) for of, rows in {"call": calls, "ref": refs}.items()]
    return tagged[0].unionByName(tagged[1]).groupBy(*keys).agg(found.alias("found")).where("found").select(src.function_id().alias("id"))


@sym_query("SELECT f.id, f.name FROM sym f WHERE f.kind = 'FUNCTION' AND f.id NOT IN (SELECT dst FROM sedge WHERE kind = 'CALLS')")
def nm10_entries(spark, d):
    """Functions that nothing calls."""
    called = src.symbol_edges(spark, d).where("kind = 'CALLS'").select(F.col("dst").alias("id"))
    return src.symbols(spark, d).where("kind = 'FUNCTION'").select("id", "name").join(called, "id", "left_anti")


@sym_query("SELECT id, kind, name, (row_number() OVER (PARTITION BY kind, file ORDER BY line_start, name, id) - 1)::INT AS decl_order FROM sym WHERE kind IN ('MACRO', 'FIELD')")
def nm11_declarations(spark, d):
    """Constants and fields in the order they are declared in their file."""
    w = Window.partitionBy("kind", "file").orderBy("line_start", "name", "id")
    return src.symbols(spark, d).where("kind IN ('MACRO', 'FIELD')").select("id", "kind", "name", (F.row_number().over(w) - 1).alias("decl_order"))


@sym_query("SELECT f.path, count(DISTINCT f.function)::BIGINT AS kernels, (SELECT count(*) FROM guard g WHERE g.path = f.path)::BIGINT AS branches, (SELECT count(*) FROM call c WHERE c.path = f.path AND starts_with(c.callee, 'Run') AND c.callee NOT IN (SELECT leaf FROM bind))::BIGINT AS gaps FROM fn f WHERE f.path LIKE 'op_kernel/%' GROUP BY f.path")
def nm12_kernel_aggregates(spark, d):
    """Per kernel file: functions, branches and calls that bind to no function."""
    f = src.functions(spark, d).where(F.col("path").startswith("op_kernel/")).groupBy("path").agg(F.count_distinct("function").alias("kernels"))
    g = _n(src.guards(spark, d), "path").withColumnRenamed("n", "branches")
    leaves = src.symbols(spark, d).where("kind = 'FUNCTION'").select(names.leaf(F.col("name")).alias("callee"), "id")
    once = leaves.groupBy("callee").agg(F.count_distinct("id").alias("k")).where("k = 1")
    gaps = _n(src.calls(spark, d).where(F.col("callee").startswith("Run")).join(once, "callee", "left_anti"), "path").withColumnRenamed("n", "gaps")
    return f.join(g, "path", "left").join(gaps, "path", "left").select("path", "kernels", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("branches", "gaps")))


@query("SELECT 'size' AS asked, d.dim, list_sort(list(DISTINCT d.value)) AS values, count(DISTINCT d.key_id)::BIGINT AS keys FROM dim d WHERE d.key_id IN (SELECT key_id FROM dim WHERE dim = 'size' AND value = '3') AND (d.dim <> 'size' OR d.value = '3') GROUP BY d.dim")
def nm13_dim_catalog(spark, d):
    """What is legal beside one value of a dim: the other dims' values and how many keys."""
    dims = encode.key_dims(spark, d)
    keys = dims.where("dim = 'size' AND value = '3'").select("key_id")
    hit = dims.join(keys, "key_id", "left_semi").where("dim <> 'size' OR value = '3'")
    return hit.groupBy(F.lit("size").alias("asked"), "dim").agg(F.sort_array(F.collect_set("value")).alias("values"), F.count_distinct("key_id").alias("keys"))


_ITEMS = r"""it AS (SELECT path, function, 'signature' AS section, 0 AS cls, line AS rank, text FROM scan WHERE function IS NOT NULL AND regexp_matches(text, '^void ')
  UNION ALL SELECT path, function, 'writes', 1, line, lhs || ' = ' || rhs FROM wr UNION ALL SELECT path, function, 'calls', 2, line, callee FROM call UNION ALL SELECT path, function, 'context', 3, line, text FROM clean),
up AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY path, function ORDER BY cls, rank, section, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, length(text) + 1 AS size FROM it),
fit AS (SELECT *, CASE WHEN upto <= 400 THEN 'kept' WHEN cls = 0 AND 400 - (upto - size) > 2 THEN 'clipped' ELSE 'shed' END AS fate FROM up)"""


@sym_query("+" + _ITEMS + """ SELECT path, function, section, count(*) FILTER (fate = 'kept')::BIGINT AS kept, count(*) FILTER (fate = 'clipped')::BIGINT AS clipped, count(*) FILTER (fate = 'shed')::BIGINT AS shed,
coalesce(sum(CASE fate WHEN 'kept' THEN size WHEN 'clipped' THEN 400 - (upto - size) END), 0)::BIGINT AS chars FROM fit GROUP BY path, function, section""")
def tk12_payload_ladder(spark, d):
    """Cards of functions cut to 400 characters: signature, writes, calls, context, in this order of worth, and what was trimmed."""
    item = lambda rows, section, cls, text: rows.select("path", "function", F.lit(section).alias("section"), F.lit(cls).alias("cls"), F.col("line").alias("rank"), text.alias("text"))
    head = src.scanned(spark, d).where("function IS NOT NULL").where(F.col("text").rlike("^void "))
    parts = [
        item(head, "signature", 0, F.col("text")), item(src.writes(spark, d), "writes", 1, F.concat_ws(" = ", "lhs", "rhs")),
        item(src.calls(spark, d), "calls", 2, F.col("callee")), item(src.bodies(spark, d), "context", 3, F.col("text")),
    ]
    return cards.trimmed(cards.shed(reduce(DataFrame.unionByName, parts), ["path", "function"], 400), ["path", "function"])
