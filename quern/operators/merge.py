"""Keyed merge-reduce of entities and relations with explicit arrival order ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.encode import trust_name, trust_rank

#: Statuses weaker than an extracted one.
WEAK = ["partial", "unresolved", "unknown", "not_extracted", "empty"]


def merge_trust() -> F.Column:
    """The weakest classified trust; unset and legacy values never count."""
    return trust_name(F.min(F.when(F.col("trust") != "legacy_unknown", trust_rank())))


def derived_trust() -> F.Column:
    """The weakest input, a legacy value ranking second, and never above derived."""
    rank = F.least(F.min(F.coalesce(trust_rank(), F.lit(1))), F.lit(2))
    return F.coalesce(trust_name(rank), F.lit("advisory"))


def minted(source: F.Column) -> F.Column:
    """(trust, state) of an edge from what made it: syntax is authoritative, declarations derive, scans and guesses are candidates; others mint none."""
    edge = lambda trust, state: F.struct(F.lit(trust).alias("trust"), F.lit(state).alias("state"))
    return F.when(source == "ast", edge("authoritative", "resolved")).when(source == "dsl", edge("derived", "resolved")).when(source.isin("lexical", "heuristic"), edge("advisory", "candidate"))


def normal_sites(sites: DataFrame) -> DataFrame:
    """(owner, file, line, rhs) once each, with slashes one way and no blanks around; sites without a line are no sites."""
    rhs = F.btrim(F.coalesce("rhs", F.lit("")))
    return sites.where("line > 0").select("owner", F.regexp_replace("file", r"\\", "/").alias("file"), "line", rhs.alias("rhs")).distinct()


def merge_entities(facts: DataFrame) -> DataFrame:
    """One row per id: attributes are last-wins, name and status first-wins, spans only widen.

    A weak first status becomes extracted when any extracted fact arrives; then, and
    only then, the confidence is the highest one.
    """
    first_status, any_extracted = F.min_by("status", "seq"), F.max((F.col("status") == "extracted").cast("int"))
    lifted = first_status.isin(WEAK) & (any_extracted == 1)
    width = F.col("line_end") - F.col("line_start")
    widest = F.max_by(F.struct("file", "line_start", "line_end"), F.struct(width, -F.col("seq")))
    return facts.groupBy("id").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"),
        F.when(lifted, "extracted").otherwise(first_status).alias("status"),
        F.when(lifted, F.max("confidence")).otherwise(F.min_by("confidence", "seq")).alias("confidence"),
        F.max_by("attr", F.when(F.col("attr").isNotNull(), F.col("seq"))).alias("attr"),
        merge_trust().alias("trust"), widest.alias("span"),
    ).select("id", "name", "status", "confidence", "attr", "trust", "span.*")


def merge_sites(sites: DataFrame) -> DataFrame:
    """One relation per (kind, src, dst) with its distinct sites, counted."""
    distinct = sites.select("kind", "src", "dst", "trust", "line", "receiver", "variant").distinct()
    return distinct.groupBy("kind", "src", "dst").agg(F.count_distinct("line", "receiver", "variant").alias("n_sites"), F.min("line").alias("first_line"), merge_trust().alias("trust"))


def unique_or_nothing(names: DataFrame, key: str, value: str) -> DataFrame:
    """Bind a key only where it names exactly one value."""
    return names.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def first_wins(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Provenance labels and markers by evidence source, in the order they are tested.
LABELS = [("ast", "authoritative", ["ast_walk"]), ("dsl", "derived", ["dsl_parse"])]
MARKERS = [("heuristic", "advisory", "heuristic"), ("lexical", "advisory", "lexical"), ("ast", "authoritative", "ast"), ("dsl", "derived", "dsl")]


def inferred(provenance: F.Column) -> F.Column:
    """(source, trust) of a provenance label: exact labels first, then markers inside it."""
    pair = lambda source, trust: F.struct(F.lit(source).alias("source"), F.lit(trust).alias("trust"))
    out, low = F.when(F.coalesce(provenance, F.lit("")) == "", pair("unspecified", "legacy_unknown")), F.lower(provenance)
    for source, trust, labels in LABELS:
        out = out.when(provenance.isin(labels), pair(source, trust))
    for source, trust, mark in MARKERS:
        out = out.when(low.contains(mark), pair(source, trust))
    return out.otherwise(pair("unspecified", "legacy_unknown"))


def with_candidates(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges with the trust of the edge that is there, or advisory if there is none."""
    keys = ["kind", "src", "dst"]
    return candidates.distinct().join(edges, keys, "left").select(*keys, F.coalesce("trust", F.lit("advisory")).alias("trust"))
