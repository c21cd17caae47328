"""Graph walks as joins: neighbourhoods, slices, distances, fixpoints, levels.

Edges are frames with ``src`` and ``dst``. Every hop's frontier is staged: a hop joins a
stored frontier with the stored edges, and no plan holds an earlier hop. Open-ended walks
end at their fixpoint; a lost executor costs a round. What has been seen is folded into
one table whenever it is in more than ``FOLD`` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.staging import bucketed, stage

FOLD = 16


def without_advisory(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("trust").eqNullSafe("advisory"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def _hops(seeds: DataFrame, edges: DataFrame, depth: int | None) -> DataFrame:
    steps = edges.select("src", "dst")
    seen = frontier = stage(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "seeds")
    parts, hop = 1, 0
    while depth is None or hop < depth:
        hop += 1
        near = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = stage(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts > FOLD:
            seen, parts = stage(seen, "seen"), 1
    return seen


def within_hops(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of what ``depth`` hops reach from ``seeds`` (column id), seeds at 0."""
    return _hops(seeds, edges, depth)


def slices(seeds: DataFrame, edges: DataFrame, depth: int, budget: int) -> DataFrame:
    """(request, id, distance, truncated) for every request of ``seeds`` (request, id), in one walk.

    A request has at most ``budget`` nodes with its seeds, admitted by distance, then id;
    ``truncated`` if nodes within ``depth`` hops were left out. A request without budget
    left walks no further.

    Of a node's neighbours the first ``budget`` + 1 by id are kept: one further back has more
    before it than a request can have seen or admit. A hop asks for the first few of each
    frontier node; the last of these that may still be admitted bounds what the others are
    asked for, so the neighbours of hubs are neither dealt nor sorted per request.
    """
    none, ids = F.array().cast("array<string>"), F.transform("nodes", lambda x: x["id"])
    left = F.lit(budget) - F.size("nodes")

    def admitted(rows: DataFrame, hop: int) -> DataFrame:
        """``new`` is in order, and holds one node more than fits if something is left out."""
        taken = F.slice("new", F.lit(1), left)
        nodes = F.concat("nodes", F.transform(taken, lambda x: F.struct(x.alias("id"), F.lit(hop).alias("distance"))))
        return stage(rows.select("request", nodes.alias("nodes"), taken.alias("ahead"), (F.col("out") | (F.size("new") > left)).alias("out")), "slice_hop")

    within = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.dense_rank().over(Window.partitionBy("src").orderBy("dst")).alias("n")).where(F.col("n") <= budget + 1)
    lists = within.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near"))
    first = top_per(seeds.select("request", "id").distinct(), ["request"], ["id"], budget + 1).groupBy("request").agg(F.array_sort(F.collect_list("id")).alias("new"))
    state = admitted(first.select("request", F.array().cast("array<struct<id:string,distance:int>>").alias("nodes"), "new", F.lit(False).alias("out")), 0)
    with bucketed(lists, "slice_edges", ["src"], deal=False) as steps:
        for hop in range(1, depth + 1):
            few = F.greatest(F.lit(2), F.ceil((left + 1) * 2 / F.size("ahead")).cast("int"))
            going = state.where("NOT out AND size(ahead) > 0").select("request", F.explode("ahead").alias("src"), few.alias("few"))
            if going.isEmpty():
                break
            more = F.when(F.size("near") > F.col("few"), F.struct("src", F.element_at("near", F.col("few")).alias("last"), "few"))
            met = going.join(steps, "src").select("request", F.slice("near", F.lit(1), F.col("few")).alias("head"), more.alias("more"))
            met = met.groupBy("request").agg(F.array_distinct(F.flatten(F.collect_list("head"))).alias("head"), F.collect_list("more").alias("more"))
            new = F.array_sort(F.array_except(F.coalesce("head", none), ids))
            found = state.join(met, "request", "left").select("request", "nodes", "out", new.alias("new"), "more").withColumn("top", F.when(F.size("new") > left, F.get("new", left)))
            open_ = F.filter("more", lambda m: F.col("top").isNull() | (m["last"] < F.col("top")))
            found = stage(found.withColumn("more", open_), "slice_found")
            rest = found.select("request", "top", F.inline("more")).join(steps, "src")
            later = F.filter(F.slice("near", F.col("few") + 1, F.lit(budget + 1)), lambda x: F.col("top").isNull() | (x < F.col("top")))
            later = top_per(rest.select("request", F.explode(later).alias("id")).distinct(), ["request"], ["id"], budget + 1).groupBy("request").agg(F.collect_list("id").alias("later"))
            both = F.array_sort(F.array_union("new", F.array_except(F.coalesce("later", none), ids)))
            state = admitted(found.join(later, "request", "left").select("request", "nodes", "out", both.alias("new")), hop)
    return state.select("request", F.inline("nodes"), F.col("out").alias("truncated"))


def slice_edges(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges leaving nodes nearer than ``depth``."""
    return edges.join(nodes.where(F.col("distance") < depth), edges["src"] == nodes["id"], "left_semi")


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, distance) of everything reachable; rounds end when a frontier is empty."""
    return _hops(seeds, stage(edges.select("src", "dst"), "edges"), None)


def bounded_walk(seeds: DataFrame, edges: DataFrame, depth: int, fanout: int, budget: int) -> DataFrame:
    """(id, distance, path) of a walk with at most ``fanout`` edges a node and ``budget`` nodes.

    Edges are taken in the order (kind, dst), nodes admitted in the order (distance, id)
    until the budget is spent, and a node is walked on only if it was admitted. Of the
    shortest ways to a node, the path is the least by its ids.
    """
    first = Window.partitionBy("src").orderBy("kind", "dst")
    seen = frontier = stage(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.array("id").alias("path")), "seeds")
    left = budget - seen.count()
    for hop in range(1, depth + 1):
        if left <= 0:
            break
        out = edges.join(frontier.select(F.col("id").alias("src"), "path"), "src").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= fanout)
        near = out.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = stage(near.orderBy("id").limit(left).select("id", F.lit(hop).alias("distance"), "path"), "frontier")
        found = frontier.count()
        if not found:
            break
        left -= found
        seen = seen.unionByName(frontier)
    return seen


def reach_with_waypoint(seeds: DataFrame, edges: DataFrame, waypoint: DataFrame, depth: int) -> DataFrame:
    """(id, has) states: whether some path to ``id`` has passed a node of ``waypoint``."""
    mark = waypoint.select("id", F.lit(True).alias("w"))
    tagged = edges.select("src", "dst").join(mark.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", F.coalesce("w", F.lit(False)).alias("w"))
    seen = frontier = stage(seeds.select("id").distinct().join(mark, "id", "left").select("id", F.coalesce("w", F.lit(False)).alias("has")), "seeds")
    for _ in range(depth):
        near = frontier.join(tagged, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("has") | F.col("w")).alias("has")).distinct()
        frontier = stage(near.join(seen, ["id", "has"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, distance, path): the first shortest path to each node by the order of its ids."""
    steps = edges.select("src", "dst").distinct()
    seen = frontier = stage(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.array("id").alias("path")), "seeds")
    for hop in range(1, depth + 1):
        near = frontier.join(steps, F.col("id") == F.col("src")).join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        near = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = stage(near.select("id", F.lit(hop).alias("distance"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def propagate_flag(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that lead to a flagged node (the flag moves against the edges)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(flagged, back).select("id")


def topo_levels(edges: DataFrame) -> DataFrame:
    """(id, level): longest distance from a node without inputs.

    Nodes that never get free, those on cycles and behind them, all have the level after
    the last one.
    """
    left = stage(edges.select("src", "dst").distinct(), "edges")
    waiting = stage(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct(), "nodes")
    done, parts, level = None, 0, 0
    while True:
        free = stage(waiting.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            rest = waiting.withColumn("level", F.lit(level))
            return rest if done is None else done.unionByName(rest)
        done, parts = (free, 1) if done is None else (done.unionByName(free), parts + 1)
        if parts > FOLD:
            done, parts = stage(done, "done"), 1
        waiting = stage(waiting.join(free, "id", "left_anti"), "waiting")
        left = stage(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst"), "left")
        level += 1


def overlapping(entities: DataFrame, file: str, lo: int, hi: int) -> DataFrame:
    lo, hi = min(lo, hi), max(lo, hi)
    return entities.where((F.col("file") == file) & (F.col("line_start") <= hi) & (F.col("line_end") >= lo))


def confirmed(edges: DataFrame) -> DataFrame:
    return edges.where(F.lower(F.coalesce("status", F.lit(""))).isin("confirmed", "extracted", "verified"))


def top_per(frame: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def family_paths(seeds: DataFrame, wanted: DataFrame, edges: DataFrame, families: list[tuple[str, list[str], int, int]], fanout: int) -> DataFrame:
    """(id, status, family, hops, path, families) for every wanted id.

    ``families`` lists (name, kinds, depth, node budget) in order of preference. A seed
    does not count as reached. Without a path the status is SEARCH_BUDGET if some walk
    spent its nodes or left edges of its last hop unwalked, else NO_PATH. ``traces`` tells
    this apart for each request.
    """
    found, spent = None, False
    for order, (family, kinds, depth, budget) in enumerate(families):
        own = edges.where(F.col("kind").isin(kinds)).select("kind", "src", "dst")
        walk = bounded_walk(seeds, own, depth, fanout, budget)
        last = walk.where(F.col("distance") == depth).select(F.col("id").alias("src"))
        spent = spent or walk.count() >= budget or not own.join(last, "src", "left_semi").isEmpty()
        rows = walk.where("distance > 0").select("id", F.lit(order).alias("ord"), F.lit(family).alias("family"), F.col("distance").alias("hops"), "path")
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("id").agg(F.min(F.struct("ord", "family", "hops", "path")).alias("b"), F.count(F.lit(1)).alias("families"))
    status = F.when(F.col("b").isNotNull(), "COMPLETE").otherwise("SEARCH_BUDGET" if spent else "NO_PATH")
    return wanted.join(best, "id", "left").select("id", status.alias("status"), "b.family", "b.hops", "b.path", F.coalesce("families", F.lit(0)).cast("long").alias("families"))
