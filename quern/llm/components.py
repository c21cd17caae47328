"""Connected components by alternating large-star and small-star steps.

Each step links neighbours to the smallest node they see; no step gathers a node's
neighbours in one place, minima are combined before the shuffle, and joins are plain
equi-joins that can be split where a hub has very many neighbours. Each round's edges
are written to the shared folder. The rounds end when the edge set stops changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y")).first()
    return r.n, r.x, r.y


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v. Links each node's larger (or smaller) neighbours to its minimum."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = (back if large else edges).join(least, "u").select(F.col("v").alias("y"), "m")
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("y"), "m"))
    return moved.where(F.col("y") != F.col("m")).select(F.greatest("y", "m").alias("u"), F.least("y", "m").alias("v")).distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every node of ``links`` (columns a, b); component is its least node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(edges, "edges")
    before = _signature(edges)
    while True:
        edges = scratch.table(_star(_star(edges, True), False), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
