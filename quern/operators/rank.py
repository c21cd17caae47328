"""Tiers, scores, interleaving and pages with explicit total orders."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import leaf
from quern.sources.staging import stage


def name_tier(name: Column, wanted: str) -> Column:
    """0 exact, 1 exact leaf, 2 prefix, 4 substring, null for no match; case is ignored."""
    n, w = F.lower(name), wanted.lower()
    return F.when(n == w, 0).when(F.lower(leaf(name)) == w, 1).when(n.startswith(w), 2).when(n.contains(w), 4)


def _last(name: Column) -> Column:
    return F.btrim(F.element_at(F.split(F.replace(name, F.lit("."), F.lit("::")), "::"), -1))


def match_tier(name: Column, id_: Column, kind: Column, wanted: str) -> Column:
    """0 a member of the wanted owner or an exact name, 1 an exact method, 2 a prefix that ends there, 3 one that goes on, 4 a substring, null for no match."""
    q = wanted.lower()
    tail = q.replace(".", "::").split("::")[-1].strip()
    low = F.lower(name)
    ident, of_id = _last(low), _last(F.replace(id_, F.lit("/"), F.lit("::")))
    owners, exact = low.startswith(f"{q}::"), (low == q) | ident.isin(q) | of_id.isin(q)
    if tail:
        owners, exact = owners | low.startswith(f"{tail}::"), exact | (ident == tail) | (of_id == tail)
    goes_on = lambda x: x.startswith(q) & F.substring(x, len(q) + 1, 1).rlike(r"[\p{L}\p{N}]")
    prefix = F.when(goes_on(low) | goes_on(ident), 3).otherwise(2)
    return F.when(owners, 0).when(exact, F.when(F.upper(kind) == "METHOD", 1).otherwise(0)).when(low.startswith(q) | ident.startswith(q), prefix).when(low.contains(q), 4)


def document_frequency(tokens: DataFrame, token: str, doc: str) -> DataFrame:
    return tokens.groupBy(token).agg(F.count_distinct(doc).alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / df)


def round_robin(hits: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Position k takes the k-th item of each group, groups by first appearance."""
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = Window.partitionBy(group)
    return hits.withColumn("turn", inside).withColumn("first_rank", F.min(order[0]).over(first))


def best_first(hits: DataFrame, group: str, order: list) -> DataFrame:
    """The best item of each group before all others."""
    w = Window.partitionBy(group).orderBy(*order)
    return hits.withColumn("again", F.least(F.row_number().over(w) - 1, F.lit(1)))


def exact_page(hits: DataFrame, exact: Column) -> DataFrame:
    """Only exact hits if there are any, else all; the flag is one aggregate joined back."""
    flag = hits.agg(F.max(exact.cast("int")).alias("_any"))
    return hits.join(F.broadcast(flag), F.coalesce("_any", F.lit(0)) <= exact.cast("int")).drop("_any")


def collapse(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Cursor:
    """A page position bound to a snapshot and a query."""

    offset: int
    snapshot: str
    query: str

    def token(self) -> str:
        return base64.urlsafe_b64encode(json.dumps([self.offset, self.snapshot, self.query]).encode()).decode()

    @classmethod
    def read(cls, token: str, snapshot: str, query: str) -> Cursor:
        found = cls(*json.loads(base64.urlsafe_b64decode(token)))
        if found.query != query:
            raise ValueError("CURSOR_MISMATCH")
        if found.snapshot != snapshot:
            raise ValueError("SNAPSHOT_CHANGED")
        return found


def fingerprint(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()[:16]


def page(frame: DataFrame, order: list, size: int, offset: int = 0) -> DataFrame:
    if not 1 <= size <= 32:
        raise ValueError("page size is 1 to 32")
    return frame.orderBy(*order).offset(offset).limit(size)


def interleaved(hits: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """The first ``size`` of the hits taken from their groups by turns, with their positions."""
    turns = round_robin(hits, group, order).orderBy("turn", "first_rank", group).limit(size)
    return turns.withColumn("position", F.row_number().over(Window.orderBy("turn", "first_rank", group))).drop("turn", "first_rank")


def owner_rank(name: Column, owner: str) -> Column:
    """0 for members of the owner that the caller named, 1 for others."""
    return F.when(name.startswith(f"{owner}::"), 0).otherwise(1)


#: Order of kinds among equal matches, and what a kind adds to a score.
KIND_ORDER = ["FUNCTION", "FIELD"]
SALIENCE = {"FIELD": 8, "FUNCTION": 2}


def arch_rank(file: Column, arch: str) -> Column:
    """0 the own architecture's files, 1 the operator's, 2 others, 3 common ones."""
    return F.when(file.contains("/common/"), 3).when(file.contains(f"/{arch}/"), 0).when(file.rlike("^op_(host|kernel)/"), 1).otherwise(2)


def agent_ranked(symbols: DataFrame, needle: str, arch: str) -> DataFrame:
    """Hits of a name, which may be qualified, with their sort keys and position.

    The position numbers a request's hits, which are few next to the symbols.
    """
    owner, _, wanted = needle.rpartition("::")
    low, leaf_, q = F.lower("name"), F.lower(leaf(F.col("name"))), wanted.lower()
    tier = F.when((low == q) | (leaf_ == q), 0).when(low.startswith(q) | leaf_.startswith(q), 3).when(low.contains(q), 4)
    kind = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        kind = F.when(F.col("kind") == k, i).otherwise(kind)
    keys = {
        "owner": owner_rank(F.col("name"), owner) if owner else F.lit(0), "tier": tier,
        "occupancy": F.when(F.col("kind") == "FIELD", 0).when(F.col("file") != "", 1).otherwise(2), "priority": kind, "arch": arch_rank(F.col("file"), arch),
    }
    hits = symbols.withColumns(keys).where("tier IS NOT NULL")
    return hits.withColumn("position", F.row_number().over(Window.orderBy(*keys, "line_start", "id")))


def locality(file: Column) -> Column:
    return F.when(file == "", -20).when(file.contains("/common/"), -10).when(file.rlike("^op_(host|kernel)/"), 20).otherwise(0)


def discovered(symbols: DataFrame, needles: list[str]) -> DataFrame:
    """(id, score) of names that hold a needle; only the exact ones if there are any.

    Of a hit the first needle counts for quality. Document frequencies are those of all
    leaves, summed before the shuffle and joined to the hits.
    """
    low, leaf_ = F.lower("name"), F.lower(leaf(F.col("name")))
    named = symbols.withColumn("leaf", leaf_)
    df = named.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    total = symbols.agg(F.count(F.lit(1)).alias("total"))
    held = F.lit(False)
    for q in needles:
        held = held | low.contains(q.lower())
    q = needles[0].lower()
    quality = F.when(F.col("leaf") == q, 100).when(F.array_contains(F.regexp_extract_all("leaf", F.lit("[a-z]+|\\d+"), F.lit(0)), q), 75).otherwise(50)
    salience = F.lit(0)
    for kind, points in SALIENCE.items():
        salience = F.when(F.col("kind") == kind, points).otherwise(salience)
    generic = F.when((F.col("df") > F.greatest(F.lit(3), F.col("total") * 0.02)) & (F.length("leaf") <= 8), -15).otherwise(0)
    located = F.when((F.col("file") != "") & (F.col("line_start") > 0), 4).otherwise(0)
    hits = named.where(held).join(df, "leaf").join(F.broadcast(total))
    scored = hits.select("id", "leaf", F.round(quality + locality(F.col("file")) + salience + 4 * idf(F.col("df"), F.col("total")) + generic + located, 4).alias("score"))
    return exact_page(scored, F.col("leaf") == q).select("id", "score")


def meant(known: DataFrame, asked: list[str], edits: int, most: int) -> DataFrame:
    """(asked, meant, rank): up to ``most`` known names within ``edits`` of each asked one.

    The asked names are a request's few; each known name is compared with them in one
    pass, and only those near enough go on.
    """
    tries = F.array(*(F.struct(F.lit(a).alias("asked"), F.levenshtein(F.lit(a), F.col("name")).alias("away")) for a in asked))
    near = known.select("name", F.explode(F.filter(tries, lambda x: x["away"] <= edits)).alias("x")).select("x.asked", "x.away", F.col("name").alias("meant"))
    w = Window.partitionBy("asked").orderBy("away", "meant")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("away")


def positions(frame: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """The place of each row in the ``order`` of its group, from 1, without a task that holds a group.

    Rows are dealt by ranges of (group, order) and stored with their range; a row's place is
    the one in its range, after the rows that the group has in the ranges before. ``order``
    must be total within a group, or equal rows are numbered as they come.
    """
    dealt = frame.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    kept = stage(dealt, "ranges")
    counts = kept.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    offsets = counts.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_range").alias("_at"), before.alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = kept.withColumn("_row", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    return placed.join(offsets, same).select(*frame.columns, (F.col("_row") + F.col("_before")).cast("int").alias(name))
