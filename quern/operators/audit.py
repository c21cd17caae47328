"""Integrity audits, digests, snapshot differences and update planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end that is no entity, and which end."""
    ids = entities.select("id").distinct()
    ends = edges.select("kind", "src", "dst", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(ids, "id", "left_anti").select("kind", "src", "dst", F.col("id").alias("missing"))


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def row_hash(frame: DataFrame, columns: list[str]) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns))), 256)


def digest(frame: DataFrame, columns: list[str]) -> DataFrame:
    """An order-independent content digest: the number of rows and two sums over their hashes.

    Sums combine before the shuffle, so no task gathers or sorts the rows' hashes.
    """
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = frame.select(row_hash(frame, columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), part(1).alias("x"), part(16).alias("y"))
    return sums.select("n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "x", "y"))), 256).alias("digest"))


def changed(old: DataFrame, new: DataFrame, key: str = "path", hash_: str = "sha") -> DataFrame:
    """(key, change): added, removed or modified; equal rows are left out. A null hash is a value of its own."""
    a, b = (frame.select(key, F.struct(hash_).alias(side)) for frame, side in ((old, "_a"), (new, "_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, change.alias("change"))


def update_mode(n_layers: int, all_layers: int, in_scope: int, needs_review: bool) -> str:
    """blocked_scope, full_extract, noop or selective, tested in that order."""
    if needs_review and not in_scope:
        return "blocked_scope"
    if n_layers and n_layers >= all_layers - 1:
        return "full_extract"
    return "noop" if not n_layers and not needs_review else "selective"


def freshness(state: DataFrame) -> DataFrame:
    """The worst state of each snapshot row, in a fixed order of severity."""
    label = (
        F.when(F.col("building"), "building").when(~F.col("compatible"), "incompatible").when(F.col("blocked"), "blocked")
        .when(F.col("revision").isNull(), "unknown").when(F.col("revision") != F.col("head"), "stale").when(F.col("dirty"), "dirty").otherwise("fresh")
    )
    return state.withColumn("freshness", label)


#: Words that can name no callable.
KEYWORDS = ["if", "for", "while", "switch", "return", "sizeof", "do", "else"]


def touching(edges: DataFrame, bad: DataFrame) -> DataFrame:
    """Edges with an end in ``bad`` (column id), and which end."""
    ends = edges.select("kind", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return ends.join(bad.distinct(), "id", "left_semi").select("kind", "src", "dst", F.col("id").alias("entity"))


def keyword_callables(entities: DataFrame) -> DataFrame:
    return entities.where(F.element_at(F.split("name", "::|\\."), -1).isin(KEYWORDS))


def leaf_only_types(types: DataFrame) -> DataFrame:
    """Types whose id and name hold no scope."""
    return types.where(F.col("id").rlike(r"^TYPE_\w+$") & ~F.col("name").contains("::"))


def required_kinds(entities: DataFrame, kinds: list[str], few: int) -> DataFrame:
    """(kind, n, level) of every required kind: block without entities, warn with fewer than ``few``."""
    wanted = entities.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    n = entities.where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    got = wanted.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return got.withColumn("level", F.when(F.col("n") == 0, "block").when(F.col("n") < few, "warn").otherwise("ok"))


def without_unproven(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges without those of the selecting ``kinds`` that have no evidence."""
    return edges.where(~(F.col("kind").isin(kinds) & F.col("evidence").isNull()))


def grounded(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are entities."""
    ids = entities.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select(*edges.columns)


#: The layers that a changed file of each role needs built again.
ROLE_LAYERS = {"host": ["host", "compile", "commit"], "kernel": ["kernel", "compile", "commit"], "common": ["host", "kernel", "template", "compile", "commit"]}
ALL_LAYERS = 5


def planned_layers(changes: DataFrame) -> DataFrame:
    """(layer, because, mode) of a change set with roles; a layer count near all makes it a full extraction."""
    layers = F.array().cast("array<string>")
    for role, needed in ROLE_LAYERS.items():
        layers = F.when(F.col("role") == role, F.array(*map(F.lit, needed))).otherwise(layers)
    rows = changes.select("role", F.explode(layers).alias("layer")).distinct()
    per = rows.groupBy("layer").agg(F.sort_array(F.collect_set("role")).alias("because"))
    n = per.agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(n)).select("layer", "because", F.when(F.col("n") >= ALL_LAYERS - 1, "full_extract").otherwise("selective").alias("mode"))
