"""Writers, readers, ordered writes, paired flags and lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The n-th write of each key, and which is the latest."""
    w, all_ = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    return writes.withColumn("version", F.row_number().over(w)).withColumn("latest", F.col("version") == F.count(F.lit(1)).over(all_))


def flag_pairs(events: DataFrame, key: str, role: str, set_role: str, wait_role: str) -> DataFrame:
    """Counts of sets and waits per key; paired where both exist. Empty keys are ignored."""
    named = events.where(F.col(key).isNotNull())
    n = lambda r: F.count_if(F.col(role) == r)
    out = named.groupBy(key).agg(n(set_role).alias("sets"), n(wait_role).alias("waits")).where("sets + waits > 0")
    return out.withColumn("paired", (F.col("sets") > 0) & (F.col("waits") > 0))


def lifetimes(events: DataFrame, scope: str, order: list, role: str, name: str, destroy: str, construct: str) -> DataFrame:
    """A pending destroy is consumed by the next construct of another name in its scope.

    A construct of the same name leaves it pending; a later destroy replaces it.
    """
    w = Window.partitionBy(scope).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = events.where(F.col(role).isin(destroy, construct))
    pending = F.last(F.when(F.col(role) == destroy, F.col(name)), ignorenulls=True).over(before)
    turn = F.sum((F.col(role) == destroy).cast("int")).over(w)
    waiting = marked.withColumn("pending", pending).withColumn("turn", turn)
    born = waiting.where((F.col(role) == construct) & F.col("pending").isNotNull() & (F.col("pending") != F.col(name)))
    first = Window.partitionBy(scope, "turn").orderBy(*order)
    return born.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(scope, F.col("pending").alias("destroyed"), F.col(name).alias("constructed")).distinct()


def assignments(edges: DataFrame, kinds: list[str], skip_prefixes: list[str]) -> DataFrame:
    """Per target, its confirmed writers; sources of the skipped kinds don't write."""
    kept = edges.where(F.col("kind").isin(kinds) & F.lower("status").isin("confirmed", "extracted", "verified"))
    for p in skip_prefixes:
        kept = kept.where(~F.col("src").startswith(p))
    return kept.groupBy("dst").agg(F.count_distinct("src").alias("writers"), F.min("src").alias("first_writer"))


def override_families(members: DataFrame, leaf: str, owner: str, base) -> DataFrame:
    """Leaves with a base and an override by another owner, and how many of each."""
    owners = members.groupBy(leaf, owner).agg(F.max(base).alias("b"), F.max(~base).alias("o"))
    per = owners.groupBy(leaf).agg(F.count_if("b").alias("nb"), F.count_if("o").alias("no"), F.max(F.when(F.col("b"), F.col(owner))).alias("base"), F.max(F.when(F.col("o"), F.col(owner))).alias("over"))
    rows = owners.join(per, leaf)
    # An owner counts unless it is itself all that stands opposite.
    alone = lambda n, only: (F.col(n) == 0) | ((F.col(n) == 1) & (F.col(only) == F.col(owner)))
    counted = rows.groupBy(leaf).agg(F.count_if(F.col("b") & ~alone("no", "over")).alias("bases"), F.count_if(F.col("o") & ~alone("nb", "base")).alias("overrides"))
    return counted.where("bases > 0")


def def_use(writes: DataFrame) -> DataFrame:
    """(path, line, name, def_line): each name used in a value with its nearest definition before, in its function.

    Definitions and uses are one sequence per (path, function, name), so the nearest is a
    window's last one and no pair of them is made.
    """
    keys = ["path", "function", "name"]
    defs = writes.select("path", "function", F.col("lhs").alias("name"), "line", F.col("line").alias("def"), F.lit(False).alias("use"))
    names = F.array_distinct(F.regexp_extract_all("rhs", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    uses = writes.select("path", "function", F.explode(names).alias("name"), "line", F.lit(None).cast("int").alias("def"), F.lit(True).alias("use"))
    before = Window.partitionBy(*keys).orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    seen = defs.unionByName(uses).withColumn("def_line", F.max("def").over(before))
    return seen.where("use AND def_line IS NOT NULL").select("path", "line", "name", "def_line").distinct()


def primary_definitions(writes: DataFrame) -> DataFrame:
    """(path, function, name, value): the definition a reader may take, null if none can be chosen.

    Definitions that mention their own name are left out unless there are no others, then
    literals unless there are no others. Literals alone count only if they agree and
    nothing was left out. Of several, the first by line is taken.
    """
    keys = ["path", "function", "name"]
    own = F.array_contains(F.regexp_extract_all("rhs", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0)), F.col("name"))
    literal = F.col("rhs").rlike(r"^(\d+|true|false)$")
    flagged = writes.withColumns({"own": own, "lit": literal})
    pool = F.col("all_own") | ~F.col("own")
    g = flagged.groupBy(*keys).agg(F.bool_and("own").alias("all_own"), F.bool_or("own").alias("any_own"))
    kept = flagged.join(g, keys).where(pool)
    best = kept.groupBy(*keys, "any_own").agg(F.min(F.when(~F.col("lit"), F.struct("line", "rhs"))).alias("value"), F.min(F.struct("line", "rhs")).alias("first"), F.count_distinct("rhs").alias("different"))
    choice = F.when(F.col("value").isNotNull(), F.col("value.rhs")).when((F.col("different") == 1) & ~F.col("any_own"), F.col("first.rhs"))
    return best.select(*keys, choice.alias("value"))


def declaration_flags(text) -> list:
    """Columns virtual, override, empty and has_body of a declaration's text."""
    empty = text.rlike(r"\{\s*\}|=\s*0\s*;")
    return [text.rlike(r"\bvirtual\b").alias("virtual"), text.rlike(r"\boverride\b").alias("override"), empty.alias("empty"), (text.contains("{") & ~empty).alias("has_body")]


def dispatch_families(members: DataFrame, leaf: str, owner: str, base) -> DataFrame:
    """(leaf, bases, overrides) of leaves with a base and an override whose owners differ."""
    is_base = base
    owners = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col(owner))))
    g = members.groupBy(leaf).agg(owners(is_base).alias("bases"), owners(~is_base).alias("overrides"))
    return g.where((F.size("bases") > 0) & (F.size("overrides") > 0) & (F.size(F.array_union("bases", "overrides")) > 1))
