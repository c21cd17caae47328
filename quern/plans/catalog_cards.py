"""Registered queries, second part: cards, locations, roles, scalars and build-time rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import audit, merge, text, traverse
from quern.plans import encode
from quern.plans.catalog import query, seed
from quern.plans.encode import table

LEAF = "lower(regexp_extract(name, '[^#.:]*$'))"


@query("SELECT DISTINCT leaf, id FROM (SELECT lower(name) AS leaf, id FROM ent UNION ALL SELECT " + LEAF + ", id FROM ent)")
def snk3_name_leaves(spark, d):
    return encode.entities(spark, d).select(F.explode(names.leaf_variants(F.col("name"))).alias("leaf"), "id").distinct()


@query("SELECT id FROM (SELECT DISTINCT lower(name) AS leaf, id FROM ent UNION SELECT " + LEAF + ", id FROM ent) WHERE leaf IN ('nation_6', '17')")
def flt3_leaf_index(spark, d):
    wanted = spark.createDataFrame([("nation_6",), ("17",)], "leaf string")
    return snk3_name_leaves(spark, d).join(F.broadcast(wanted), "leaf", "left_semi").select("id").distinct()


@query("SELECT e.id, r.n FROM ent e LEFT JOIN (SELECT src, count(*)::BIGINT AS n FROM rel GROUP BY src) r ON r.src = e.id")
def jn2_left_outer(spark, d):
    n = encode.relations(spark, d).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return encode.entities(spark, d).select("id").join(n, "id", "left")


@query("SELECT m.value AS brand, s.value AS size, count(*)::BIGINT AS n FROM dim m JOIN dim s USING (key_id) WHERE m.dim = 'brand' AND s.dim = 'size' GROUP BY ALL")
def jn5_postings_self_join(spark, d):
    dims = encode.key_dims(spark, d)
    of = lambda x: dims.where(F.col("dim") == x).select("key_id", F.col("value").alias(x))
    return of("brand").join(of("size"), "key_id").groupBy("brand", "size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM ent WHERE id IN (SELECT dst FROM rel WHERE kind = 'BINDS')")
def jn9_semi_join(spark, d):
    bound = encode.relations(spark, d).where("kind = 'BINDS'").select(F.col("dst").alias("id"))
    return encode.entities(spark, d).select("id").join(bound, "id", "left_semi")


@query("SELECT path FROM line GROUP BY path HAVING bool_or(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) > 60)")
def jn11_array_exists(spark, d):
    lines = encode.source_lines(spark, d).withColumn("w", names.identifiers(F.col("text")))
    return lines.groupBy("path").agg(F.bool_or(F.size("w") > 60).alias("any")).where("any").select("path")


@query("SELECT id, kind FROM (SELECT dst AS id FROM rel WHERE src = 'NATION:6' UNION SELECT src FROM rel WHERE dst = 'NATION:6') JOIN ent USING (id) WHERE kind IN ('SUPPLIER', 'REGION')")
def gr21_constraints(spark, d):
    near = traverse.symmetric(encode.relations(spark, d)).where("src = 'NATION:6'").select(F.col("dst").alias("id")).distinct()
    return near.join(encode.entities(spark, d).where("kind IN ('SUPPLIER', 'REGION')").select("id", "kind"), "id")


@query("SELECT src AS id, kind, dst FROM (SELECT src, kind, dst, row_number() OVER (PARTITION BY src, kind ORDER BY dst) AS r FROM (SELECT kind, src, dst FROM rel UNION SELECT kind, dst, src FROM rel) WHERE src LIKE 'NATION:%') WHERE r <= 4")
def gr25_around_one_hop(spark, d):
    near = traverse.symmetric(encode.relations(spark, d).select("kind", "src", "dst")).where(F.col("src").startswith("NATION:")).distinct()
    return traverse.top_per(near, ["src", "kind"], ["dst"], 4).select(F.col("src").alias("id"), "kind", "dst")


@query("+w AS (SELECT 'CUSTOMER:1' AS id, 0 AS d UNION SELECT rel.dst, w.d + 1 FROM w JOIN rel ON rel.src = w.id WHERE w.d < 3) SELECT count(*) > 0 AS found FROM w WHERE id LIKE 'SUPPLIER:%'", recursive=True)
def gr33_path_exists(spark, d):
    near = traverse.within_hops(seed(spark, "CUSTOMER:1"), encode.relations(spark, d), 3)
    return near.agg((F.count_if(F.col("id").startswith("SUPPLIER:")) > 0).alias("found"))


@query("SELECT file, count(*)::BIGINT AS n, min(line_start)::INT AS first FROM ent GROUP BY file")
def ag18_by_file(spark, d):
    return encode.entities(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line_start").alias("first"))


@query("SELECT dim, list_sort(list(DISTINCT value)) AS values FROM dim WHERE key_id IN (SELECT key_id FROM dim WHERE dim = 'type' AND value LIKE 'S%') GROUP BY dim")
def ag8_block_match(spark, d):
    dims = encode.key_dims(spark, d)
    keys = dims.where((F.col("dim") == "type") & F.col("value").startswith("S")).select("key_id").distinct()
    return dims.join(keys, "key_id", "left_semi").groupBy("dim").agg(F.sort_array(F.collect_set("value")).alias("values"))


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY CUBE (p_brand, p_type)", graph=False)
def ext_dim_cube(spark, d):
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, kind, (CASE kind WHEN 'PART' THEN 0 WHEN 'SUPPLIER' THEN 1 WHEN 'ORDER' THEN 2 ELSE 9 END)::INT AS priority FROM ent")
def tk11_priority_order(spark, d):
    return encode.entities(spark, d).select("id", "kind", F.when(F.col("kind") == "PART", 0).when(F.col("kind") == "SUPPLIER", 1).when(F.col("kind") == "ORDER", 2).otherwise(9).alias("priority"))


@query("SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM (SELECT src AS id, kind, 0 AS o FROM rel WHERE kind = 'BINDS' UNION ALL SELECT dst, kind, 1 FROM rel WHERE kind = 'READS')) WHERE r = 1")
def set2_union_first_wins(spark, d):
    r = encode.relations(spark, d)
    both = r.where("kind = 'BINDS'").select(F.col("src").alias("id"), "kind", F.lit(0).alias("o")).unionByName(r.where("kind = 'READS'").select(F.col("dst").alias("id"), "kind", F.lit(1).alias("o")))
    return merge.first_wins(both, ["id"], ["o", "kind"]).select("id", "kind")


@query("SELECT kind || '_' || substr(upper(sha256(kind || chr(31) || name || chr(31) || file)), 1, 12) AS minted, id FROM ent")
def sf4_minted_ids(spark, d):
    e = encode.entities(spark, d)
    minted = F.concat("kind", F.lit("_"), F.substring(names.minted_id("x", F.col("kind"), F.col("name"), F.col("file")), 3, 12))
    return e.select(minted.alias("minted"), "id")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events", graph=False)
def af5_json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("+h AS (SELECT path, line FROM line WHERE contains(lower(text), 'onth')) SELECT (SELECT count(*) FROM h)::BIGINT AS total, path, line FROM h ORDER BY path, line LIMIT 10")
def tx6_recall_with_total(spark, d):
    hits = text.matching(encode.source_lines(spark, d), "onth").select("path", "line")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("path", "line").limit(10).join(F.broadcast(total)).select("total", "path", "line")


@query("SELECT path, line, text FROM line WHERE line BETWEEN 3 AND 7")
def lc4_source_window(spark, d):
    return encode.source_lines(spark, d).where(F.col("line").between(3, 7))


@query("SELECT 'span:' || entity_id AS handle, path, line_start, line_end FROM span WHERE kind = 'UNIT'")
def lc12_evidence_spans(spark, d):
    return encode.spans(spark, d).where("kind = 'UNIT'").select(F.concat(F.lit("span:"), "entity_id").alias("handle"), "path", "line_start", "line_end")


@query("SELECT kind, src, dst, dst AS missing FROM rel WHERE kind = 'BINDS' AND status = 'confirmed' AND dst IN (SELECT 'SUPPLIER:' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)")
def au1_confirmed_dangling(spark, d):
    known = encode.entities(spark, d).where("NOT (kind = 'SUPPLIER' AND line_start % 10 = 0)")
    return audit.dangling(traverse.confirmed(encode.relations(spark, d)).where("kind = 'BINDS'"), known)


@query("+e AS (SELECT kind, file, line_start FROM ent UNION ALL SELECT kind, file, line_start FROM ent WHERE line_start % 10 = 3) SELECT kind, file, line_start, count(*)::BIGINT AS n FROM e GROUP BY ALL HAVING count(*) > 1")
def au7_duplicate_local_objects(spark, d):
    """Objects of one kind at one place under two ids; a tenth are doubled here as the defect."""
    e = encode.entities(spark, d)
    return audit.duplicates(e.unionByName(e.where("line_start % 10 = 3").withColumn("id", F.concat("id", F.lit("b")))), ["kind", "file", "line_start"])


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents", graph=False)
def upd1_source_stamps(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"))
