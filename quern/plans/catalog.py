"""Registered graph queries over the driver tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import audit, intervals, lineage, merge, postings, rank, text, traverse
from quern.plans import encode
from quern.plans.encode import GRAPH_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "", graph: bool = True, recursive: bool = False, base: str = GRAPH_SQL):
    """Register a function under its name with an oracle over the encoded graph (or another ``base``)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{base}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}") if graph else sql
        return f

    return add


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


# -- scans, filters, projections ------------------------------------------------------


@query("SELECT path, line, text FROM line")
def src7_source_line(spark, d):
    return encode.source_lines(spark, d)


@query("SELECT DISTINCT path FROM line")
def src8_file_inventory(spark, d):
    return encode.source_lines(spark, d).select("path").distinct()


@query("SELECT kind, src, dst, status, trust FROM rel WHERE kind IN ('CONTAINS', 'CALLS')")
def src2_graph_slice(spark, d):
    return encode.relations(spark, d).where(F.col("kind").isin("CONTAINS", "CALLS"))


@query("SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)", graph=False)
def src9_lexical_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT key_id, dim, value FROM dim")
def snk2_postings(spark, d):
    return encode.key_dims(spark, d)


@query("SELECT id, name FROM ent WHERE kind = 'NATION' AND name = 'NATION_6'")
def flt1_by_kind_and_name(spark, d):
    return encode.entities(spark, d).where((F.col("kind") == "NATION") & (F.col("name") == "NATION_6")).select("id", "name")


@query("SELECT id, name FROM ent WHERE lower(regexp_extract(name, '[^#.:]*$')) = '17'")
def flt2_leaf_lookup(spark, d):
    return encode.entities(spark, d).where(F.lower(names.leaf(F.col("name"))) == "17").select("id", "name")


@query("""SELECT id, CASE WHEN lower(name) = 'order#1' THEN 0 WHEN lower(regexp_extract(name, '[^#.:]*$')) = 'order#1' THEN 1 WHEN lower(name) LIKE 'order#1%' THEN 2 ELSE 4 END AS tier
FROM ent WHERE lower(name) LIKE '%order#1%'""")
def flt4_tiered_entity_search(spark, d):
    return encode.entities(spark, d).select("id", rank.name_tier(F.col("name"), "order#1").alias("tier")).where("tier is not null")


@query("""+tok AS (SELECT * FROM (VALUES ('NATION_6', 0), ('NATION_7', 1), ('nation_6', 2)) t(t, o)),
m AS (SELECT id, o, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM ent JOIN tok ON lower(name) = lower(t))
SELECT id, o AS needle FROM m WHERE r = 1""")
def flt5_multi_needle(spark, d):
    needles = spark.createDataFrame([("NATION_6", 0), ("NATION_7", 1), ("nation_6", 2)], "t string, needle int")
    hits = encode.entities(spark, d).join(needles, F.lower("name") == F.lower("t"))
    return merge.first_wins(hits.select("id", "needle"), ["id"], ["needle"])


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '11')", graph=False)
def flt7_json_literal_filter(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(k.isin("7", "11")).select("event_id", k.cast("int").alias("k"))


@query("SELECT id FROM ent WHERE name LIKE 'Customer#%7'")
def flt9_name_glob(spark, d):
    return encode.entities(spark, d).where(names.name_like(F.col("name"), "Customer#*7")).select("id")


@query("SELECT DISTINCT path FROM line WHERE regexp_matches(path, '^(.*/)?[^/]*9$')")
def flt10_path_glob(spark, d):
    return encode.source_lines(spark, d).where(names.path_matches(F.col("path"), "**/*9")).select("path").distinct()


@query("SELECT kind, src, dst FROM rel WHERE trust IS DISTINCT FROM 'advisory'")
def flt11_not_advisory(spark, d):
    return traverse.without_advisory(encode.relations(spark, d)).select("kind", "src", "dst")


@query("SELECT kind, src, dst FROM rel WHERE lower(status) IN ('confirmed', 'extracted', 'verified')")
def flt12_confirmed_edges(spark, d):
    return traverse.confirmed(encode.relations(spark, d)).select("kind", "src", "dst")


@query("SELECT trust, CASE trust WHEN 'authoritative' THEN 'A' WHEN 'derived' THEN 'B' ELSE 'C' END AS tier, count(*)::BIGINT AS n FROM rel GROUP BY ALL")
def prj4_trust_tiers(spark, d):
    tier = F.when(F.col("trust") == "authoritative", "A").when(F.col("trust") == "derived", "B").otherwise("C")
    return encode.relations(spark, d).groupBy("trust", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# -- joins ----------------------------------------------------------------------------


@query("SELECT r.kind, s.kind AS src_kind, t.kind AS dst_kind, count(*)::BIGINT AS n FROM rel r JOIN ent s ON r.src = s.id JOIN ent t ON r.dst = t.id GROUP BY ALL")
def jn1_edge_endpoints(spark, d):
    e = encode.entities(spark, d).select("id", "kind")
    r = encode.relations(spark, d).withColumnRenamed("kind", "rel")
    both = r.join(e.withColumnsRenamed({"id": "src", "kind": "src_kind"}), "src").join(e.withColumnsRenamed({"id": "dst", "kind": "dst_kind"}), "dst")
    return both.groupBy(F.col("rel").alias("kind"), "src_kind", "dst_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CASE WHEN src = 'NATION:6' THEN dst ELSE src END AS id, kind FROM rel WHERE src = 'NATION:6' OR dst = 'NATION:6'")
def jn3_undirected_neighbors(spark, d):
    return traverse.symmetric(encode.relations(spark, d)).where(F.col("src") == "NATION:6").select(F.col("dst").alias("id"), "kind").distinct()


@query("""SELECT path, line, entity_id FROM (
SELECT l.path, l.line, s.entity_id, row_number() OVER (PARTITION BY l.path, l.line ORDER BY s.line_end - s.line_start, s.entity_id) AS r
FROM line l JOIN span s ON l.path = s.path AND l.line BETWEEN s.line_start AND s.line_end WHERE s.line_end > s.line_start) WHERE r = 1""")
def jn7_line_to_unit(spark, d):
    lines = encode.source_lines(spark, d).select("path", "line")
    return intervals.enclosing_unit(lines, encode.spans(spark, d).drop("kind"), ["path", "line"]).select("path", "line", "entity_id")


@query("""+w AS (SELECT path || '#' || a AS window_id, path, a::INT AS w_start, (a + 6)::INT AS w_end FROM (SELECT path, unnest(range(1, n + 1, 7)) AS a FROM last))
SELECT window_id, entity_id, (least(w_end, line_end) - greatest(w_start, line_start) + 1)::INT AS overlap FROM w JOIN span s ON w.path = s.path AND w_start <= line_end AND line_start <= w_end""")
def jn8_window_overlap(spark, d):
    s = encode.spans(spark, d)
    last = s.where("kind = 'FILE'").select("path", F.col("line_end").alias("n"))
    w = last.select("path", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(7))).alias("a")).select(F.concat("path", F.lit("#"), F.col("a").cast("string")).alias("window_id"), "path", F.col("a").cast("int").alias("w_start"), (F.col("a") + 6).cast("int").alias("w_end"))
    return intervals.overlaps(w, s.drop("kind")).select("window_id", "entity_id", F.col("overlap").cast("int").alias("overlap"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM events""", graph=False)
def jn12_asof_preceding(spark, d):
    e = table(spark, d, "events")
    return intervals.preceding(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "last_signup").select("event_id", "last_signup")


@query("SELECT leaf, min(id) AS id FROM (SELECT lower(regexp_extract(name, '[^#.:]*$')) AS leaf, id FROM ent) GROUP BY leaf HAVING count(DISTINCT id) = 1")
def jn14_unique_or_nothing(spark, d):
    leaves = encode.entities(spark, d).select(F.lower(names.leaf(F.col("name"))).alias("leaf"), "id")
    return merge.unique_or_nothing(leaves, "leaf", "id")


# -- traversal ------------------------------------------------------------------------

_HOPS = """+e AS (SELECT src, dst FROM rel WHERE {where}),
w AS ({start} UNION SELECT {to}, w.distance + 1 FROM w JOIN e ON {on} WHERE w.distance < {depth})"""
_OUT = {"to": "e.dst", "on": "e.src = w.id"}
_BOTH = "+e AS (SELECT src, dst FROM rel WHERE trust <> 'advisory' UNION SELECT dst, src FROM rel WHERE trust <> 'advisory'),\nw AS ({start} UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.id WHERE w.distance < {depth})"


@query(_BOTH.format(start="SELECT 'CUSTOMER:1' AS id, 0 AS distance", depth=2) + " SELECT id, ent.kind, min(distance)::INT AS distance FROM w JOIN ent USING (id) GROUP BY ALL", recursive=True)
def gr2_neighbors_2hop(spark, d):
    edges = traverse.symmetric(traverse.without_advisory(encode.relations(spark, d)))
    near = traverse.within_hops(seed(spark, "CUSTOMER:1"), edges, 2)
    return encode.entities(spark, d).select("id", "kind").join(near, "id")


@query("SELECT src AS id, kind, count(*)::BIGINT AS n FROM rel GROUP BY ALL")
def gr1_neighbor_counts(spark, d):
    return encode.relations(spark, d).groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, kind, dst, rank FROM (SELECT src, kind, dst, row_number() OVER (PARTITION BY src ORDER BY kind, dst)::INT AS rank FROM rel) WHERE rank <= 3")
def gr3_edges_of_many(spark, d):
    return traverse.top_per(encode.relations(spark, d), ["src"], ["kind", "dst"], 3).select("src", "kind", "dst", "rank")


@query(_HOPS.format(where="trust <> 'advisory'", start="SELECT 'NATION:6' AS id, 0 AS distance", depth=3, **_OUT) + " SELECT id, min(distance)::INT AS distance FROM w GROUP BY id", recursive=True)
def gr4_slice_forward_3(spark, d):
    return traverse.within_hops(seed(spark, "NATION:6"), traverse.without_advisory(encode.relations(spark, d)), 3)


@query(_HOPS.format(where="trust <> 'advisory'", start="SELECT 'SUPPLIER:3' AS id, 0 AS distance", depth=3, to="e.src", on="e.dst = w.id") + " SELECT id, min(distance)::INT AS distance FROM w GROUP BY id", recursive=True)
def gr4_slice_backward_3(spark, d):
    r = traverse.without_advisory(encode.relations(spark, d))
    return traverse.within_hops(seed(spark, "SUPPLIER:3"), r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3)


@query(_HOPS.format(where="trust <> 'advisory'", start="SELECT 'NATION:6' AS id, 0 AS distance", depth=2, **_OUT) + ", n AS (SELECT id, min(distance) AS distance FROM w GROUP BY id) SELECT r.kind, r.src, r.dst FROM rel r JOIN n ON r.src = n.id WHERE trust <> 'advisory' AND n.distance < 2", recursive=True)
def gr5_slice_edges(spark, d):
    r = traverse.without_advisory(encode.relations(spark, d))
    return traverse.slice_edges(traverse.within_hops(seed(spark, "NATION:6"), r, 2), r, 2).select("kind", "src", "dst")


@query(_HOPS.format(where="true", start="SELECT 'REGION:1' AS id, 0 AS distance", depth=5, **_OUT) + " SELECT id, min(distance)::INT AS distance FROM w WHERE id LIKE 'SUPPLIER:%' GROUP BY id", recursive=True)
def gr6_shortest_distance(spark, d):
    near = traverse.within_hops(seed(spark, "REGION:1"), encode.relations(spark, d), 5)
    return near.where(F.col("id").startswith("SUPPLIER:"))


@query("""+e AS (SELECT src, dst FROM rel WHERE kind IN ('CONTAINS', 'CALLS')), w AS (SELECT 'NATION:6' AS id, 0 AS distance, ['NATION:6'] AS path UNION SELECT e.dst, w.distance + 1, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.id WHERE w.distance < 2),
m AS (SELECT id, min(distance) AS distance FROM w GROUP BY id) SELECT w.id, w.distance::INT AS distance, min(w.path) AS path FROM w JOIN m ON m.id = w.id AND m.distance = w.distance GROUP BY w.id, w.distance""", recursive=True)
def gr7_shortest_paths(spark, d):
    return traverse.shortest_paths(seed(spark, "NATION:6"), encode.relations(spark, d).where("kind IN ('CONTAINS', 'CALLS')"), 2)


@query("""+e AS (SELECT src, dst FROM rel), w AS (SELECT 'NATION:6' AS id, 0 AS distance, false AS has
UNION SELECT e.dst, w.distance + 1, w.has OR e.dst LIKE 'PART:%' FROM w JOIN e ON e.src = w.id WHERE w.distance < 4)
SELECT id, bool_or(has) AS has FROM w GROUP BY id""", recursive=True)
def gr8_waypoint_path_exists(spark, d):
    parts = encode.entities(spark, d).where("kind = 'PART'").select("id")
    states = traverse.reach_with_waypoint(seed(spark, "NATION:6"), encode.relations(spark, d), parts, 4)
    return states.groupBy("id").agg(F.bool_or("has").alias("has"))


@query(_BOTH.format(start="SELECT 'PART:5' AS id, 0 AS distance", depth=2) + " SELECT id, min(distance)::INT AS distance FROM w JOIN ent USING (id) WHERE ent.kind IN ('SUPPLIER', 'CUSTOMER') GROUP BY id", recursive=True)
def gr9_reachable_kinds(spark, d):
    near = traverse.within_hops(seed(spark, "PART:5"), traverse.symmetric(traverse.without_advisory(encode.relations(spark, d))), 2)
    return near.join(encode.entities(spark, d).where("kind IN ('SUPPLIER', 'CUSTOMER')"), "id", "left_semi")


@query(_HOPS.format(where="trust <> 'advisory'", start="SELECT id, 0 AS distance FROM ent WHERE file = 'orders/3' AND line_start <= 130 AND line_end >= 100", depth=2, **_OUT) + " SELECT id, min(distance)::INT AS distance, CASE min(distance) WHEN 0 THEN 'seed' ELSE 'slice_neighbor' END AS label FROM w GROUP BY id", recursive=True)
def gr10_impact_of_lines(spark, d):
    hit = traverse.overlapping(encode.entities(spark, d), "orders/3", 130, 100)
    near = traverse.within_hops(hit, traverse.without_advisory(encode.relations(spark, d)), 2)
    return near.withColumn("label", F.when(F.col("distance") == 0, "seed").otherwise("slice_neighbor"))


@query("+e AS (SELECT src, dst FROM rel WHERE kind IN ('READS', 'BINDS') UNION SELECT dst, src FROM rel WHERE kind IN ('READS', 'BINDS')), w AS (SELECT 'ORDER:1' AS id, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.id WHERE w.distance < 3) SELECT id, min(distance)::INT AS distance, id LIKE 'SUPPLIER:%' AS sink FROM w GROUP BY id", recursive=True)
def gr11_impact_closure(spark, d):
    edges = traverse.symmetric(encode.relations(spark, d).where("kind IN ('READS', 'BINDS')"))
    return traverse.within_hops(seed(spark, "ORDER:1"), edges, 3).withColumn("sink", F.col("id").startswith("SUPPLIER:"))


@query("""SELECT dst AS id, count(*) FILTER (status IN ('confirmed', 'extracted', 'verified'))::BIGINT AS called_by, count(*) FILTER (status NOT IN ('confirmed', 'extracted', 'verified'))::BIGINT AS possible_callers
FROM rel WHERE kind = 'CALLS' GROUP BY dst""")
def gr18_calls_in_out(spark, d):
    sure = F.lower("status").isin("confirmed", "extracted", "verified")
    calls = encode.relations(spark, d).where("kind = 'CALLS'")
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count_if(sure).alias("called_by"), F.count_if(~sure).alias("possible_callers"))


@query("""SELECT dst, src, rank FROM (SELECT r.dst, r.src, row_number() OVER (PARTITION BY r.dst ORDER BY e.line_start, r.src)::INT AS rank FROM rel r JOIN ent e ON e.id = r.src WHERE r.kind = 'READS') WHERE rank <= 5""")
def gr19_writer_reach_topn(spark, d):
    callers = encode.entities(spark, d).select(F.col("id").alias("src"), "line_start")
    reads = encode.relations(spark, d).where("kind = 'READS'").join(callers, "src")
    return traverse.top_per(reads, ["dst"], ["line_start", "src"], 5).select("dst", "src", "rank")


@query("SELECT DISTINCT src AS id, dst AS supplier FROM rel WHERE kind = 'BINDS' AND status = 'confirmed'")
def gr23_confirmed_neighbors(spark, d):
    r = traverse.confirmed(encode.relations(spark, d)).where("kind = 'BINDS'")
    return r.select(F.col("src").alias("id"), F.col("dst").alias("supplier")).distinct()


@query("+w AS (SELECT 'REGION:0' AS id UNION SELECT rel.dst FROM w JOIN rel ON rel.src = w.id WHERE rel.kind IN ('CONTAINS', 'CALLS')) SELECT id FROM w", recursive=True)
def gr26_reachable_from_roots(spark, d):
    return traverse.reach(seed(spark, "REGION:0"), encode.relations(spark, d).where("kind IN ('CONTAINS', 'CALLS')")).select("id")


@query("+w AS (SELECT 'PART:9' AS id UNION SELECT rel.src FROM w JOIN rel ON rel.dst = w.id WHERE trust <> 'advisory') SELECT id FROM w", recursive=True)
def gr27_reverse_fixpoint(spark, d):
    return traverse.propagate_flag(seed(spark, "PART:9"), traverse.without_advisory(encode.relations(spark, d)))


@query("+w AS (SELECT id FROM ent WHERE kind = 'SUPPLIER' AND name LIKE '%7' UNION SELECT rel.src FROM w JOIN rel ON rel.dst = w.id WHERE kind IN ('BINDS', 'CONTAINS')) SELECT id FROM w", recursive=True)
def gr28_flag_propagation(spark, d):
    flagged = encode.entities(spark, d).where("kind = 'SUPPLIER' AND name LIKE '%7'").select("id")
    return traverse.propagate_flag(flagged, encode.relations(spark, d).where("kind IN ('BINDS', 'CONTAINS')"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'page:' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
w AS (SELECT '/de' AS id UNION SELECT e.src FROM w JOIN e ON e.dst = w.id) SELECT id FROM w""", graph=False)
def gr29_include_reverse_closure(spark, d):
    e = src9_lexical_scan(spark, d).select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.col("href").alias("dst"))
    return traverse.propagate_flag(seed(spark, "/de"), e)


@query("""+e AS (SELECT DISTINCT src, dst FROM rel WHERE kind IN ('CONTAINS', 'CALLS')),
w AS (SELECT DISTINCT src AS id, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id)
SELECT id, max(level)::INT AS level FROM w GROUP BY id""", recursive=True)
def gr30_topo_levels(spark, d):
    return traverse.topo_levels(encode.relations(spark, d).where("kind IN ('CONTAINS', 'CALLS')"))


@query("""WITH m AS (SELECT regexp_extract(p_name, '[^ ]*$') AS leaf, p_brand AS owner, p_size % 3 = 0 AS base FROM part)
SELECT b.leaf, count(DISTINCT b.owner)::BIGINT AS bases, count(DISTINCT o.owner)::BIGINT AS overrides FROM m b JOIN m o ON b.leaf = o.leaf AND b.base AND NOT o.base AND b.owner <> o.owner GROUP BY b.leaf""", graph=False)
def gr32_override_families(spark, d):
    m = table(spark, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("leaf"), F.col("p_brand").alias("owner"), "p_size")
    return lineage.override_families(m, "leaf", "owner", F.col("p_size") % 3 == 0)


# -- aggregation ----------------------------------------------------------------------


@query("SELECT kind, count(*)::BIGINT AS n FROM ent GROUP BY kind UNION ALL SELECT kind, count(*)::BIGINT FROM rel GROUP BY kind")
def ag1_kind_counts(spark, d):
    count = lambda f: f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return count(encode.entities(spark, d)).unionByName(count(encode.relations(spark, d)))


@query("SELECT dim, value, count(*)::BIGINT AS n FROM dim GROUP BY ALL")
def ag2_dim_value_counts(spark, d):
    return encode.key_dims(spark, d).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


_K = "+k AS (SELECT key_id FROM dim WHERE dim = 'brand' AND value = 'Brand#11')"


@query(_K + """ SELECT u.dim, u.value, count(DISTINCT k.key_id)::BIGINT AS n FROM (SELECT DISTINCT dim, value FROM dim WHERE dim <> 'brand') u
LEFT JOIN dim x ON u.dim = x.dim AND u.value = x.value LEFT JOIN k ON k.key_id = x.key_id GROUP BY ALL""")
def ag3_cross_counts_with_zeros(spark, d):
    return postings.cross_counts(encode.key_dims(spark, d), "brand", "Brand#11")


@query("""SELECT a.value AS value_a, b.value AS value_b, (SELECT count(*) FROM dim x JOIN dim y USING (key_id) WHERE x.dim = 'brand' AND y.dim = 'size' AND x.value = a.value AND y.value = b.value)::BIGINT AS n
FROM (SELECT DISTINCT value FROM dim WHERE dim = 'brand') a, (SELECT DISTINCT value FROM dim WHERE dim = 'size') b""")
def ag4_pair_grid(spark, d):
    return postings.pair_grid(encode.key_dims(spark, d), "brand", "size")


@query("SELECT key_id FROM dim WHERE (dim = 'brand' AND value = 'Brand#11') OR (dim = 'size' AND value IN ('1', 'true')) GROUP BY key_id HAVING count(DISTINCT dim) = 2")
def ag5_postings_intersection(spark, d):
    return postings.intersection(encode.key_dims(spark, d), {"brand": "Brand#11", "size": "true"})


@query("""+h AS (SELECT DISTINCT key_id, dim FROM dim WHERE (dim = 'brand' AND value = 'Brand#11') OR (dim = 'size' AND value = '99')),
f AS (SELECT unnest(['brand', 'size']) AS dropped), o AS (SELECT f.dropped, h.key_id FROM f JOIN h ON h.dim <> f.dropped GROUP BY ALL HAVING count(*) = 1)
SELECT o.dropped, count(DISTINCT o.key_id)::BIGINT AS total, list_sort(list(DISTINCT d.value)) AS values FROM o JOIN dim d ON d.key_id = o.key_id AND d.dim = o.dropped GROUP BY o.dropped""")
def ag6_nearby_relaxation(spark, d):
    return postings.nearby(encode.key_dims(spark, d), {"brand": "Brand#11", "size": "99"})


@query("""+b AS (SELECT DISTINCT p_type AS block_id, dim, value FROM dim JOIN part ON key_id = p_partkey WHERE dim IN ('brand', 'size')),
h AS (SELECT block_id FROM b WHERE dim = 'size' AND value = '3' GROUP BY block_id)
SELECT dim, list_sort(list(DISTINCT value)) AS values FROM b SEMI JOIN h USING (block_id) WHERE dim <> 'size' OR value = '3' GROUP BY dim""")
def ag7_block_cover(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("key_id"), F.col("p_type").alias("block_id"))
    blocks = encode.key_dims(spark, d).where("dim in ('brand', 'size')").join(kinds, "key_id").select("block_id", "dim", "value").distinct()
    return postings.cover(blocks, {"size": "3"})


#: Types of parts as template blocks; a flag is stored in three spellings.
_BLOCKS = """blk AS MATERIALIZED (SELECT DISTINCT p_type AS block_id, unnest(['brand', 'size', 'flag']) AS dim, unnest([p_brand, (p_size % 40)::VARCHAR, CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '0' ELSE 'high' END]) AS value FROM part),
ask AS (SELECT s_suppkey AS request, 'size' AS dim, (s_suppkey % 45)::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 'brand', 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 6) FROM supplier WHERE s_suppkey % 3 > 0
  UNION ALL SELECT s_suppkey, 'flag', CASE s_suppkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'false' ELSE 'high' END FROM supplier WHERE s_suppkey % 3 = 2)"""
_COVERS = _BLOCKS + """, sp AS (SELECT DISTINCT request, dim, value AS asked, unnest(CASE WHEN lower(trim(value)) IN ('1', 'true') THEN ['1', 'true', 'True', 'TRUE'] WHEN lower(trim(value)) IN ('0', 'false') THEN ['0', 'false', 'False', 'FALSE'] ELSE [value] END) AS value FROM ask),
k AS (SELECT request, count(*) AS k FROM ask GROUP BY request), met AS MATERIALIZED (SELECT DISTINCT request, dim, block_id FROM sp JOIN blk USING (dim, value)),
sub AS (SELECT request, '' AS dropped, k FROM k UNION ALL SELECT request, dim, k - 1 FROM ask JOIN k USING (request)),
hit AS MATERIALIZED (SELECT request, dropped, block_id FROM sub JOIN met USING (request) WHERE dim <> dropped GROUP BY request, dropped, block_id, k HAVING count(*) = k
  UNION ALL SELECT request, dropped, block_id FROM sub, (SELECT DISTINCT block_id FROM blk) WHERE k = 0),
n AS (SELECT request, dropped, count(*)::BIGINT AS blocks FROM hit GROUP BY ALL),
v AS (SELECT DISTINCT hit.request, dropped, blk.dim, blk.value, sp.value IS NOT NULL AS own, ask.dim IS NOT NULL AS pin FROM hit JOIN blk USING (block_id) LEFT JOIN ask ON ask.request = hit.request AND ask.dim = blk.dim LEFT JOIN sp ON sp.request = hit.request AND sp.dim = blk.dim AND sp.value = blk.value),
w AS (SELECT request, '' AS dropped, dim, CASE WHEN pin THEN [coalesce(min(value) FILTER (value IN ('0', '1')), min(value))] ELSE list_sort(list(value)) END AS values FROM v WHERE dropped = '' AND (NOT pin OR own) GROUP BY request, dim, pin),
x AS (SELECT request, dropped, list_sort(list(value)) AS values FROM v WHERE dropped = dim GROUP BY ALL)"""


@query("+" + _COVERS + """ SELECT request, dropped, blocks, dim, values FROM n JOIN w USING (request, dropped)
UNION ALL SELECT request, dropped, blocks, dropped, coalesce(values, []) FROM n LEFT JOIN x USING (request, dropped) WHERE dropped <> '' AND request NOT IN (SELECT request FROM n WHERE dropped = '')""")
def ag7_template_covers(spark, d):
    """For each supplier's request: the values its matching blocks cover, or what leaving each filter out would give."""
    size, k = F.col("p_size"), F.col("s_suppkey")
    flag = F.when(size % 4 == 0, "1").when(size % 4 == 1, "true").when(size % 4 == 2, "0").otherwise("high")
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), v.alias("value")) for n, v in (("brand", F.col("p_brand")), ("size", (size % 40).cast("string")), ("flag", flag))]))
    blocks = table(spark, d, "part").select(F.col("p_type").alias("block_id"), dims.alias("x")).select("block_id", "x.*").distinct()
    brand = F.when(k % 3 > 0, F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + k % 6).cast("string")))
    said = F.when(k % 3 == 2, F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "1").when(k % 5 == 2, "false").otherwise("high"))
    filters = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), v.alias("value")) for n, v in (("size", (k % 45).cast("string")), ("brand", brand), ("flag", said))]))
    asked = table(spark, d, "supplier").select(k.alias("request"), filters.alias("x")).select("request", "x.*").where("value IS NOT NULL")
    return postings.covers(blocks, asked)


@query("SELECT dim, count(DISTINCT value)::BIGINT AS n, count(DISTINCT value) = 1 AS fixed FROM dim GROUP BY dim")
def ag9_dim_coverage(spark, d):
    return encode.key_dims(spark, d).groupBy("dim").agg(F.count_distinct("value").alias("n")).withColumn("fixed", F.col("n") == 1)


_TOK = "tok AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM line)"


@query(f"+{_TOK} SELECT token, count(DISTINCT path)::BIGINT AS df, round(ln(((SELECT count(DISTINCT path) FROM line) + 1) / count(DISTINCT path)), 4) AS idf FROM tok GROUP BY token")
def ag11_idf(spark, d):
    lines = encode.source_lines(spark, d)
    tokens = lines.select("path", F.explode(names.identifiers(F.col("text"))).alias("token"))
    n = lines.agg(F.count_distinct("path").alias("n"))
    return rank.document_frequency(tokens, "token", "path").join(F.broadcast(n)).select("token", "df", F.round(rank.idf(F.col("df"), F.col("n")), 4).alias("idf"))


@query("""SELECT kind, dst, n, rank FROM (SELECT kind, dst, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, dst)::INT AS rank FROM (SELECT kind, dst, count(*)::BIGINT AS n FROM rel GROUP BY ALL)) WHERE rank <= 8""")
def ag12_topk_per_relation(spark, d):
    n = encode.relations(spark, d).groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("n"))
    return traverse.top_per(n, ["kind"], [F.desc("n"), "dst"], 8).select("kind", "dst", "n", "rank")


@query("SELECT kind, dst, count(DISTINCT (line, receiver, variant))::BIGINT AS sites FROM site GROUP BY ALL")
def ag13_call_site_counts(spark, d):
    return encode.sites(spark, d).groupBy("kind", "dst").agg(F.count_distinct("line", "receiver", "variant").alias("sites"))


@query("SELECT dst, count(DISTINCT src)::BIGINT AS writers, min(src) AS first_writer FROM rel WHERE kind IN ('CALLS', 'BINDS') AND status IN ('confirmed', 'extracted', 'verified') AND src NOT LIKE 'REGION:%' GROUP BY dst")
def ag14_assignments_by_writer(spark, d):
    return lineage.assignments(encode.relations(spark, d), ["CALLS", "BINDS"], ["REGION:"])


@query("SELECT dst, count(*) FILTER (src LIKE 'ORDER:%')::BIGINT AS consumers, count(*) FILTER (src LIKE 'PART:%')::BIGINT AS producers, count(*)::BIGINT AS total FROM rel WHERE kind IN ('READS', 'BINDS') GROUP BY dst")
def ag15_producer_consumer_split(spark, d):
    by = lambda p: F.count_if(F.col("src").startswith(p))
    return encode.relations(spark, d).where("kind in ('READS', 'BINDS')").groupBy("dst").agg(by("ORDER:").alias("consumers"), by("PART:").alias("producers"), F.count(F.lit(1)).alias("total"))


@query("""+h AS (SELECT path, line FROM line WHERE contains(lower(text), 'tion')), u AS (SELECT h.path, h.line, s.entity_id, row_number() OVER (PARTITION BY h.path, h.line ORDER BY s.line_end - s.line_start, s.entity_id) AS r
FROM h JOIN span s ON h.path = s.path AND h.line BETWEEN s.line_start AND s.line_end)
SELECT entity_id, count(*)::BIGINT AS hits, min(line)::INT AS first FROM u WHERE r = 1 GROUP BY entity_id""")
def ag19_hits_by_unit(spark, d):
    hits = text.matching(encode.source_lines(spark, d), "tion").select("path", "line")
    unit = intervals.enclosing_unit(hits, encode.spans(spark, d).drop("kind"), ["path", "line"], one_line=True)
    return unit.groupBy("entity_id").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first"))


@query("SELECT s.entity_id, s.line_start, greatest(s.line_start, least(s.line_end + 5, n))::INT AS line_end FROM span s JOIN last USING (path)")
def ag20_span_clamp(spark, d):
    wide = encode.spans(spark, d).withColumn("line_end", F.col("line_end") + 5)
    return intervals.clamp(wide, encode.source_lines(spark, d)).select("entity_id", "line_start", F.col("line_end").cast("int").alias("line_end"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'signup')::BIGINT AS sets, count(*) FILTER (event_type = 'purchase')::BIGINT AS waits,
count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AS paired FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) FILTER (event_type IN ('signup', 'purchase')) > 0""", graph=False)
def ag21_flag_pairs(spark, d):
    return lineage.flag_pairs(table(spark, d, "events"), "user_id", "event_type", "signup", "purchase")


@query("SELECT user_id, date_trunc('day', ts)::DATE AS day, count(*) FILTER (event_type = 'signup')::BIGINT AS signup, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL", graph=False)
def ag22_sync_scopes(spark, d):
    e = table(spark, d, "events").where("event_type in ('signup', 'purchase')").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").pivot("event_type", ["signup", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT trust, count(*)::BIGINT AS n FROM rel GROUP BY trust")
def ag23_trust_summary(spark, d):
    return encode.relations(spark, d).groupBy("trust").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS edges, count(*) FILTER (status = 'partial')::BIGINT AS partial, count(*) FILTER (trust = 'advisory')::BIGINT AS advisory, count(DISTINCT kind)::BIGINT AS kinds FROM rel")
def ag25_audit_cardinalities(spark, d):
    r = encode.relations(spark, d)
    return r.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("trust") == "advisory").alias("advisory"), F.count_distinct("kind").alias("kinds"))


@query("""+h AS (SELECT sha256(dst || chr(31) || kind || chr(31) || src || chr(31) || status || chr(31) || trust) AS h FROM rel),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT)::HUGEINT AS x, sum(('0x' || substr(h, 16, 15))::UBIGINT::HUGEINT)::HUGEINT AS y FROM h)
SELECT n::BIGINT AS n, sha256(n || '|' || x || '|' || y) AS digest FROM s""")
def ag27_graph_digest(spark, d):
    return audit.digest(encode.relations(spark, d), ["kind", "src", "dst", "status", "trust"])


# -- windows, ranking, pages ----------------------------------------------------------


@query("SELECT event_id, row_number() OVER w::INT AS version, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", graph=False)
def wn3_ssa_versions(spark, d):
    return lineage.versions(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "version", "latest")


@query("""SELECT path, line, entity_id, depth FROM (SELECT l.path, l.line, s.entity_id, row_number() OVER (PARTITION BY l.path, l.line ORDER BY s.line_end - s.line_start, s.entity_id)::INT AS depth
FROM line l JOIN span s ON l.path = s.path AND l.line BETWEEN s.line_start AND s.line_end WHERE s.line_end > s.line_start AND l.line <> s.line_start) WHERE depth <= 3""")
def wn4_innermost_guards(spark, d):
    lines = encode.source_lines(spark, d).select("path", "line")
    return intervals.innermost(lines, encode.spans(spark, d).drop("kind"), ["path", "line"]).select("path", "line", "entity_id", "depth")


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type, json_extract_string(props, '$.k') AS name FROM events WHERE event_type IN ('error', 'view')),
p AS (SELECT *, count(*) FILTER (event_type = 'error') OVER w AS turn, arg_max(name, (ts, event_id)) FILTER (event_type = 'error') OVER w AS pending FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, turn ORDER BY ts, event_id) AS r FROM p WHERE event_type = 'view' AND turn > 0 AND pending <> name)
SELECT DISTINCT user_id, pending AS destroyed, name AS constructed FROM b WHERE r = 1""", graph=False)
def wn7_lifetime_edges(spark, d):
    e = table(spark, d, "events").withColumn("name", F.get_json_object("props", "$.k"))
    return lineage.lifetimes(e, "user_id", ["ts", "event_id"], "event_type", "name", "error", "view")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::INT AS ordinal FROM events", graph=False)
def wn9_occurrence_ordinals(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).alias("ordinal"))


@query("SELECT id FROM ent WHERE name = 'NATION_6'")
def tk5_exactness_page(spark, d):
    hits = encode.entities(spark, d).where(F.lower("name").contains("nation_6"))
    return rank.exact_page(hits, F.lower("name") == "nation_6").select("id")


@query("""+h AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line)::INT AS turn, min(line) OVER (PARTITION BY path)::INT AS first_rank FROM line WHERE contains(lower(text), 'tion')) SELECT path, line, turn, first_rank FROM h""")
def tk6_round_robin_by_file(spark, d):
    hits = text.matching(encode.source_lines(spark, d), "tion").select("path", "line")
    return rank.round_robin(hits, "path", ["line"])


@query("+h AS (SELECT path, line, least(row_number() OVER (PARTITION BY path ORDER BY length(text) DESC, line) - 1, 1)::INT AS again FROM line WHERE contains(lower(text), 'tion')) SELECT path, line, again FROM h")
def tk7_diversify(spark, d):
    hits = text.matching(encode.source_lines(spark, d), "tion").select("path", "line", "text")
    return rank.best_first(hits, "path", [F.desc(F.length("text")), "line"]).select("path", "line", F.col("again").cast("int").alias("again"))


@query("SELECT lower(regexp_extract(name, '[^#.:]*$')) AS leaf, list_sort(list(DISTINCT kind)) AS kinds, count(*)::BIGINT AS n FROM ent GROUP BY 1")
def tk8_collapse_by_name(spark, d):
    return rank.collapse(encode.entities(spark, d).withColumn("leaf", F.lower(names.leaf(F.col("name")))), ["leaf"])


@query("SELECT key_id FROM dim WHERE dim = 'brand' AND value = 'Brand#11' ORDER BY key_id LIMIT 20 OFFSET 10")
def tk9_page(spark, d):
    return rank.page(encode.key_dims(spark, d).where("dim = 'brand' AND value = 'Brand#11'").select("key_id"), ["key_id"], 20, 10)


# -- sets, scalars, text --------------------------------------------------------------

_AB = """WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents WHERE doc_id % 17 <> 0),
b AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 19 <> 0)"""


def _snapshots(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    a = docs.where("doc_id % 17 <> 0").select("path", F.sha2("text", 256).alias("sha"))
    return a, docs.where("doc_id % 19 <> 0").select("path", F.sha2(edited, 256).alias("sha"))


@query(_AB + " SELECT path, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.sha IS DISTINCT FROM b.sha", graph=False)
def set3_changed_paths(spark, d):
    return audit.changed(*_snapshots(spark, d))


@query("SELECT DISTINCT dst AS id FROM rel WHERE kind = 'READS' INTERSECT SELECT src FROM rel WHERE kind = 'BINDS'")
def set1_intersection(spark, d):
    r = encode.relations(spark, d)
    return r.where("kind = 'READS'").select(F.col("dst").alias("id")).intersect(r.where("kind = 'BINDS'").select("src"))


@query("SELECT p_partkey, ((p_size % 64) | ((p_partkey % 1024) << 6))::BIGINT AS packed, (p_size % 64)::BIGINT AS size FROM part", graph=False)
def nf1_pack_unpack_key(spark, d):
    p = table(spark, d, "part").withColumn("packed", postings.pack([(F.col("p_size") % 64, 6), (F.col("p_partkey") % 1024, 10)]))
    return p.select("p_partkey", "packed", postings.unpack(F.col("packed"), 0, 6).alias("size"))


@query("SELECT p_type, brand, size FROM (SELECT DISTINCT p_type, p_brand AS brand FROM part) JOIN (SELECT DISTINCT p_type, p_size % 4 AS size FROM part) USING (p_type)", graph=False)
def exp1_legal_instances(spark, d):
    domains = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("brand"), F.collect_set(F.col("p_size") % 4).alias("size"))
    return postings.legal_instances(domains, ["brand", "size"])


@query(r"SELECT path, line FROM line WHERE regexp_matches(text, 'ness\.|tion\.')")
def tx2_regex_search(spark, d):
    return text.matching(encode.source_lines(spark, d), r"ness\.|tion\.").select("path", "line")


@query("SELECT path, line FROM line WHERE regexp_matches(text, 'ention|ering')")
def tx3_prefiltered_search(spark, d):
    return text.matching(encode.source_lines(spark, d), "ention|ering").select("path", "line")


@query("SELECT id FROM ent WHERE regexp_matches(name || chr(10) || file, 'Customer#0*1[0-9]')")
def tx4_entity_haystack(spark, d):
    e = encode.entities(spark, d).withColumn("haystack", F.concat_ws("\n", "name", "file"))
    return text.matching(e, "Customer#0*1[0-9]", "haystack").select("id")


@query("SELECT path, line FROM line WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def tx5_and_tokens(spark, d):
    return text.all_tokens(encode.source_lines(spark, d), ["the", "tion"]).select("path", "line")


@query("SELECT token, (SELECT count(*) FROM line WHERE contains(lower(text), token))::BIGINT AS n FROM (SELECT unnest(['tion', 'zzqq', 'ering']) AS token)")
def tx7_zero_hit_suggestions(spark, d):
    return text.suggestions(encode.source_lines(spark, d), ["tion", "zzqq", "ering"])


# -- merge, audits, updates -----------------------------------------------------------


@query("SELECT kind, src, dst, count(DISTINCT (line, receiver, variant))::BIGINT AS n_sites, min(line)::INT AS first_line, CASE min(rank) WHEN 0 THEN 'advisory' WHEN 2 THEN 'derived' ELSE 'authoritative' END AS trust FROM site GROUP BY kind, src, dst")
def merge_relation_sites(spark, d):
    return merge.merge_sites(encode.sites(spark, d))


@query("""WITH f AS (SELECT 'USER:' || user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'partial' WHEN 'view' THEN 'extracted' ELSE 'other' END AS status, value AS confidence, event_type AS attr FROM events)
SELECT id, CASE WHEN arg_min(status, seq) = 'partial' AND max((status = 'extracted')::INT) = 1 THEN 'extracted' ELSE arg_min(status, seq) END AS status,
round(CASE WHEN arg_min(status, seq) = 'partial' AND max((status = 'extracted')::INT) = 1 THEN max(confidence) ELSE arg_min(confidence, seq) END, 4) AS confidence, arg_max(attr, seq) AS attr FROM f GROUP BY id""", graph=False)
def merge_entities(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "partial").when(F.col("event_type") == "view", "extracted").otherwise("other")
    facts = e.select(
        F.concat(F.lit("USER:"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), status.alias("status"),
        F.col("value").alias("confidence"), F.col("event_type").alias("attr"), F.lit("derived").alias("trust"), F.lit("f").alias("file"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"),
    )
    return merge.merge_entities(facts).select("id", "status", F.round("confidence", 4).alias("confidence"), "attr")


@query("SELECT src, CASE least(min(CASE trust WHEN 'advisory' THEN 0 WHEN 'derived' THEN 2 ELSE 3 END), 2) WHEN 0 THEN 'advisory' ELSE 'derived' END AS trust FROM rel GROUP BY src")
def derive_trust(spark, d):
    return encode.relations(spark, d).groupBy("src").agg(merge.derived_trust().alias("trust"))


@query("SELECT kind, src, dst, count(*)::BIGINT AS n FROM site GROUP BY kind, src, dst HAVING count(*) > 1")
def au4_duplicate_triples(spark, d):
    return audit.duplicates(encode.sites(spark, d), ["kind", "src", "dst"])


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", graph=False)
def au5_duplicate_declarations(spark, d):
    return audit.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT kind, count(*)::BIGINT AS n FROM rel WHERE status = 'partial' AND trust IN ('derived', 'authoritative') GROUP BY kind")
def au8_trust_violations(spark, d):
    return encode.relations(spark, d).where("status = 'partial' AND trust IN ('derived', 'authoritative')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_AB + ", c AS (SELECT path, a.sha IS NULL AS fresh, b.sha IS NULL AS gone FROM a FULL JOIN b USING (path) WHERE a.sha IS DISTINCT FROM b.sha) SELECT source, count(*) FILTER (fresh)::BIGINT AS added, count(*) FILTER (gone)::BIGINT AS removed, count(*) FILTER (NOT fresh AND NOT gone)::BIGINT AS modified FROM c JOIN documents ON doc_id::VARCHAR = path GROUP BY source", graph=False)
def upd4_change_classes(spark, d):
    n = lambda x: F.count_if(F.col("change") == x)
    where = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "source")
    return audit.changed(*_snapshots(spark, d)).join(where, "path").groupBy("source").agg(n("added").alias("added"), n("removed").alias("removed"), n("modified").alias("modified"))


@query("SELECT id, file FROM ent WHERE file IN ('orders/3', 'part/7')")
def upd6_impacted_nodes(spark, d):
    files = spark.createDataFrame([("orders/3",), ("part/7",)], "file string")
    return encode.entities(spark, d).join(F.broadcast(files), "file", "left_semi").select("id", "file")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'building' WHEN o_orderkey % 7 = 0 THEN 'incompatible' WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderstatus = 'P' THEN 'unknown'
WHEN o_orderstatus <> 'F' THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'dirty' ELSE 'fresh' END AS freshness FROM orders""", graph=False)
def upd8_freshness(spark, d):
    k = F.col("o_orderkey")
    state = table(spark, d, "orders").select(
        "o_orderkey", (k % 11 == 0).alias("building"), (k % 7 != 0).alias("compatible"), (k % 5 == 0).alias("blocked"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("revision"), F.lit("F").alias("head"), (k % 2 == 0).alias("dirty"),
    )
    return audit.freshness(state).select("o_orderkey", "freshness")
