"""Families of virtual functions: bases, overrides, and where calls by name may go.

Members of a family share the last part of their name. Who is a base and who overrides it
is chosen in tiers over the whole family; the tiers, and whether a member of another type
stands opposite, follow from each family's flags and from the least and greatest type of
its bases and overrides. No member is compared with another, so a family of any size costs
its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import declaration_flags


def stem(file: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")


def _type(owner: Column, file: Column) -> Column:
    """What tells members' types apart: the owner, or the file's stem where none is known."""
    return F.when(F.coalesce(owner, F.lit("")) != "", F.concat(F.lit("o:"), owner)).otherwise(F.concat(F.lit("f:"), stem(file)))


def members(declared: DataFrame) -> DataFrame:
    """(leaf, id, file, line, owner, type, virtual, override, empty, has_body) of (leaf, id, file, line, owner, text).

    Of several at one place (file stem and line) the one that knows its owner stays, then
    one that is virtual, then the first by id.
    """
    rows = declared.where(F.coalesce("leaf", F.lit("")) != "").select("leaf", "id", "file", "line", F.coalesce("owner", F.lit("")).alias("owner"), *declaration_flags(F.coalesce("text", F.lit(""))))
    best = F.struct((F.col("owner") == "").alias("a"), (~F.col("virtual")).alias("b"), "id")
    kept = rows.groupBy("leaf", stem(F.col("file")).alias("_stem"), "line").agg(F.min_by(F.struct("id", "file", "owner", "virtual", "override", "empty", "has_body"), best).alias("m"))
    return kept.select("leaf", "line", "m.*", _type(F.col("m.owner"), F.col("m.file")).alias("type"))


def families(found: DataFrame) -> DataFrame:
    """(leaf, role, id, file, line, owner): the bases and overrides of every family that has both.

    Bases are virtual and empty, else merely virtual. Overrides say so and have a body,
    else have a body and are of another type than some base. Both stay only if some member
    of the other role is of another type.
    """
    ends = lambda cond, name: (F.min(F.when(cond, F.col("type"))).alias(f"{name}_lo"), F.max(F.when(cond, F.col("type"))).alias(f"{name}_hi"))
    virtual, stub, said = F.col("virtual"), F.col("virtual") & F.col("empty"), F.col("override") & F.col("has_body")
    first = found.groupBy("leaf").agg(F.max(stub).alias("stubs"), F.max(said).alias("says"), *ends(stub, "s"), *ends(virtual, "v"), *ends(said, "o"))
    rows = found.join(first, "leaf")
    base = F.when(F.col("stubs"), stub).otherwise(virtual)
    low, high = (F.when(F.col("stubs"), F.col(f"s_{e}")).otherwise(F.col(f"v_{e}")) for e in ("lo", "hi"))
    other = lambda a, b: F.coalesce((a != F.col("type")) | (b != F.col("type")), F.lit(False))
    over = F.when(F.col("says"), said).otherwise(F.col("has_body")) & other(low, high)
    marked = rows.select("leaf", "id", "file", "line", "owner", "type", base.alias("base"), over.alias("over"))
    second = marked.groupBy("leaf").agg(*ends(F.col("over"), "w"))
    role = F.explode(F.filter(F.array(F.when(F.col("base") & other(F.col("w_lo"), F.col("w_hi")), F.lit("base")), F.when(F.col("over"), F.lit("override"))), lambda x: x.isNotNull()))
    return marked.join(second, "leaf").select("leaf", role.alias("role"), "id", "file", "line", "owner")


def dispatch_edges(sites: DataFrame, family: DataFrame) -> DataFrame:
    """(site, leaf, dst): a call of a family's name may reach each of its overrides. ``sites`` has (site, leaf)."""
    over = family.where("role = 'override'").select("leaf", F.col("id").alias("dst"))
    return sites.select("site", "leaf").distinct().join(over, "leaf").select("site", "leaf", "dst")
