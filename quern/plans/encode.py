"""The driver tables as a typed property graph, lines, spans and postings.

Entities are rows of the dimension tables; relations are topology-unique, and each line
item is one observation (site) of an edge. The same rules stand in ``GRAPH_SQL`` for
the oracles. The tables are stored at their first use in a session, sorted for lookups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import gramindex
from quern.sources.snapshot import lookup_table

#: Evidence ranks, weakest first.
TRUST_RANK = {"advisory": 0, "legacy_unknown": 1, "derived": 2, "authoritative": 3}
#: Relation families of the encoded kinds.
FAMILIES = {"call": ["CALLS"], "data": ["READS"], "control": ["BINDS"], "compile": ["CONTAINS"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(spark, sf_dir, "entities", lambda: _entities(spark, sf_dir), "id")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str, source: str, key: str, name: Column, width: int) -> DataFrame:
        return table(spark, sf_dir, source).select(
            node(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.lit("extracted").alias("status"),
            F.concat(F.lit(f"{source}/"), (F.col(key) % 10).cast("string")).alias("file"),
            F.col(key).cast("int").alias("line_start"), (F.col(key) + F.col(key) % width).cast("int").alias("line_end"),
        )

    parts = [
        of("REGION", "region", "r_regionkey", F.col("r_name"), 3), of("NATION", "nation", "n_nationkey", F.col("n_name"), 5),
        of("CUSTOMER", "customer", "c_custkey", F.col("c_name"), 7), of("SUPPLIER", "supplier", "s_suppkey", F.col("s_name"), 7),
        of("PART", "part", "p_partkey", F.col("p_name"), 11), of("ORDER", "orders", "o_orderkey", F.concat(F.lit("order#"), F.col("o_orderkey").cast("string")), 13),
    ]
    return reduce(DataFrame.unionByName, parts)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation of a READS or BINDS edge."""
    li = table(spark, sf_dir, "lineitem")
    trust = F.when(F.col("l_returnflag") == "R", "advisory").when(F.col("l_returnflag") == "A", "derived").otherwise("authoritative")
    cols = [trust.alias("trust"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("receiver"), F.to_date("l_shipdate").alias("variant")]
    reads = li.select(F.lit("READS").alias("kind"), node("ORDER", "l_orderkey").alias("src"), node("PART", "l_partkey").alias("dst"), *cols)
    binds = li.select(F.lit("BINDS").alias("kind"), node("PART", "l_partkey").alias("src"), node("SUPPLIER", "l_suppkey").alias("dst"), *cols)
    return reads.unionByName(binds)


def trust_rank(column: str = "trust") -> Column:
    out = F.lit(None).cast("int")
    for name, rank in TRUST_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def trust_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TRUST_RANK)), rank + 1)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(spark, sf_dir, "relations", lambda: _relations(spark, sf_dir), "src")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst, status, trust): one row per edge, whatever its number of sites."""
    fixed = lambda df, src, dst: df.select(F.lit("CONTAINS").alias("kind"), src.alias("src"), dst.alias("dst"), F.lit("confirmed").alias("status"), F.lit("authoritative").alias("trust"))
    nation = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "extracted").otherwise("partial")
    seen = sites(spark, sf_dir).groupBy("kind", "src", "dst").agg(trust_name(F.min(trust_rank())).alias("trust"))
    parts = [
        fixed(nation, node("REGION", "n_regionkey"), node("NATION", "n_nationkey")),
        fixed(table(spark, sf_dir, "customer"), node("NATION", "c_nationkey"), node("CUSTOMER", "c_custkey")),
        fixed(table(spark, sf_dir, "supplier"), node("NATION", "s_nationkey"), node("SUPPLIER", "s_suppkey")),
        orders.select(F.lit("CALLS").alias("kind"), node("CUSTOMER", "o_custkey").alias("src"), node("ORDER", "o_orderkey").alias("dst"), status.alias("status"), F.lit("derived").alias("trust")),
        seen.select("kind", "src", "dst", F.lit("confirmed").alias("status"), "trust"),
    ]
    return reduce(DataFrame.unionByName, parts)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(spark, sf_dir, "source_lines", lambda: _source_lines(spark, sf_dir), "path")


def _source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text): non-blank lines, numbered from 1."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return rows.where(F.btrim("text") != "").select("path", (F.col("at") + 1).cast("int").alias("line"), "text")


def line_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text index of the source lines, built once."""
    return lookup_table(spark, sf_dir, "line_trigrams", lambda: gramindex.build(source_lines(spark, sf_dir)), "gram", "part", deal=False)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(spark, sf_dir, "spans", lambda: _spans(spark, sf_dir), "path")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested units per path: blocks of 4 lines inside blocks of 12 lines inside the file."""
    last = source_lines(spark, sf_dir).groupBy("path").agg(F.max("line").alias("n"))

    def blocks(kind: str, width: int) -> DataFrame:
        starts = last.select("path", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(width))).alias("a"))
        return starts.select(
            F.concat_ws(":", F.lit(kind), "path", "a").alias("entity_id"), F.lit(kind).alias("kind"), "path",
            F.col("a").cast("int").alias("line_start"), F.least("n", F.col("a") + width - 1).cast("int").alias("line_end"),
        )

    whole = last.select(F.concat_ws(":", F.lit("FILE"), "path").alias("entity_id"), F.lit("FILE").alias("kind"), "path", F.lit(1).alias("line_start"), F.col("n").alias("line_end"))
    return blocks("BLOCK", 4).unionByName(blocks("UNIT", 12)).unionByName(whole)


def key_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(spark, sf_dir, "key_dims", lambda: _key_dims(spark, sf_dir), "key_id")


def _key_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_id, dim, value): parts unpivoted to postings."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (F.col("p_size") % 8).cast("string").alias("size"))
    return part.unpivot("key_id", ["brand", "type", "size"], "dim", "value")


GRAPH_SQL = """
ent AS (
  SELECT 'REGION:' || r_regionkey AS id, 'REGION' AS kind, r_name AS name, 'region/' || (r_regionkey % 10) AS file, r_regionkey::INT AS line_start, (r_regionkey + r_regionkey % 3)::INT AS line_end FROM region
  UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION', n_name, 'nation/' || (n_nationkey % 10), n_nationkey::INT, (n_nationkey + n_nationkey % 5)::INT FROM nation
  UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'CUSTOMER', c_name, 'customer/' || (c_custkey % 10), c_custkey::INT, (c_custkey + c_custkey % 7)::INT FROM customer
  UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'SUPPLIER', s_name, 'supplier/' || (s_suppkey % 10), s_suppkey::INT, (s_suppkey + s_suppkey % 7)::INT FROM supplier
  UNION ALL SELECT 'PART:' || p_partkey, 'PART', p_name, 'part/' || (p_partkey % 10), p_partkey::INT, (p_partkey + p_partkey % 11)::INT FROM part
  UNION ALL SELECT 'ORDER:' || o_orderkey, 'ORDER', 'order#' || o_orderkey, 'orders/' || (o_orderkey % 10), o_orderkey::INT, (o_orderkey + o_orderkey % 13)::INT FROM orders),
site AS (
  SELECT 'READS' AS kind, 'ORDER:' || l_orderkey AS src, 'PART:' || l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 2 ELSE 3 END AS rank, l_linenumber AS line, l_suppkey AS receiver, l_shipdate::DATE AS variant FROM lineitem
  UNION ALL SELECT 'BINDS', 'PART:' || l_partkey, 'SUPPLIER:' || l_suppkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber, l_suppkey, l_shipdate::DATE FROM lineitem),
rel AS (
  SELECT 'CONTAINS' AS kind, 'REGION:' || n_regionkey AS src, 'NATION:' || n_nationkey AS dst, 'confirmed' AS status, 'authoritative' AS trust FROM nation
  UNION ALL SELECT 'CONTAINS', 'NATION:' || c_nationkey, 'CUSTOMER:' || c_custkey, 'confirmed', 'authoritative' FROM customer
  UNION ALL SELECT 'CONTAINS', 'NATION:' || s_nationkey, 'SUPPLIER:' || s_suppkey, 'confirmed', 'authoritative' FROM supplier
  UNION ALL SELECT 'CALLS', 'CUSTOMER:' || o_custkey, 'ORDER:' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'extracted' ELSE 'partial' END, 'derived' FROM orders
  UNION ALL SELECT kind, src, dst, 'confirmed', CASE min(rank) WHEN 0 THEN 'advisory' WHEN 2 THEN 'derived' ELSE 'authoritative' END FROM site GROUP BY kind, src, dst),
line AS (
  SELECT path, i::INT AS line, text FROM (
    SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(text) <> ''),
last AS (SELECT path, max(line) AS n FROM line GROUP BY path),
span AS (
  SELECT 'BLOCK:' || path || ':' || a AS entity_id, 'BLOCK' AS kind, path, a::INT AS line_start, least(n, a + 3)::INT AS line_end FROM (SELECT path, n, unnest(range(1, n + 1, 4)) AS a FROM last)
  UNION ALL SELECT 'UNIT:' || path || ':' || a, 'UNIT', path, a::INT, least(n, a + 11)::INT FROM (SELECT path, n, unnest(range(1, n + 1, 12)) AS a FROM last)
  UNION ALL SELECT 'FILE:' || path, 'FILE', path, 1, n FROM last),
dim AS (
  SELECT p_partkey AS key_id, 'brand' AS dim, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'size', (p_size % 8)::VARCHAR FROM part)"""
