"""Expansion of macros in source lines, each with the definitions that it can meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.macros import expand_with, parse_definition
from quern.sources.staging import stage

NAME = r"[A-Za-z_]\w*"


def definitions(lines: DataFrame) -> DataFrame:
    """(name, params, body) of the ``#define`` lines; of several of a name the first by file and line."""
    found = lines.where(F.col("text").rlike(r"^\s*#\s*define\b")).select("path", "line", parse_definition("text").alias("d"))
    first = Window.partitionBy("d.name").orderBy("path", "line")
    return found.where("d.name IS NOT NULL").withColumn("n", F.row_number().over(first)).where("n = 1").select("d.name", "d.params", "d.body")


def closed(defined: DataFrame) -> DataFrame:
    """(name, meets): every definition that one's expansion can meet, itself included.

    A round joins pairs with what their last definition names; rounds end when none is new.
    """
    names = defined.select(F.col("name").alias("next"))
    steps = stage(defined.select("name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(NAME), F.lit(0)))).alias("next")).join(names, "next"), "macro_steps")
    seen = frontier = stage(defined.select("name", F.col("name").alias("meets")), "macros")
    while True:
        near = frontier.select("name", F.col("meets").alias("own")).join(steps.select(F.col("name").alias("own"), "next"), "own").select("name", F.col("next").alias("meets")).distinct()
        frontier = stage(near.join(seen, ["name", "meets"], "left_anti"), "macros")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def expand(lines: DataFrame, keys: list[str], defined: DataFrame) -> DataFrame:
    """``lines`` (keys and text) expanded; null where an expansion would pass the bound.

    Only what a line names, directly or through other definitions, goes to it.
    """
    used = lines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"))
    met = used.join(closed(defined), "name").select(*keys, F.col("meets").alias("name")).distinct().join(defined, "name")
    own = met.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.collect_list(F.struct("name", "params", "body")).alias("_defined"))
    joined = lines.select(*keys, "text").join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.select(*keys, F.when(F.col("_defined").isNull(), F.col("text")).otherwise(expand_with("text", "_defined")).alias("text"))
