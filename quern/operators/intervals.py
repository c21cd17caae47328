"""Joins of lines and line ranges, binned so that they are equi-joins.

A span is listed under every bin of ``BIN`` lines that it touches and a line under its
own, so the join is on (path, bin) with the exact comparison after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def _binned(spans: DataFrame) -> DataFrame:
    first, last = F.floor(F.col("line_start") / BIN), F.floor(F.col("line_end") / BIN)
    return spans.withColumn("_bin", F.explode(F.sequence(first, last)))


def containing(lines: DataFrame, spans: DataFrame, one_line: bool = False) -> DataFrame:
    """Every (line row, span) with the line inside; one-line spans only if asked."""
    wide = spans if one_line else spans.where(F.col("line_end") > F.col("line_start"))
    return lines.withColumn("_bin", F.floor(F.col("line") / BIN)).join(_binned(wide), ["path", "_bin"]).where(F.col("line").between(F.col("line_start"), F.col("line_end"))).drop("_bin")


def counts_within(spans: DataFrame, keys: list[str], facts: dict[str, DataFrame], parts: int) -> DataFrame:
    """Spans (path, ``keys``, line_start, line_end) with the number of each kind of fact (path, line) on their lines.

    Facts are summed along the file, and a span has the difference of the sums at its two
    ends: no pair of fact and span is a row. Both are dealt by path to ``parts`` partitions once.
    """
    own = [*(F.col(k) for k in keys)]
    none = [F.lit(None).cast(spans.schema[k].dataType).alias(k) for k in keys]
    at = lambda frame, line, turn, kind, cols: frame.select("path", F.col(line).alias("line"), F.lit(turn).alias("turn"), F.lit(kind).alias("kind"), *cols)
    events = [at(spans, "line_start", 0, None, own), at(spans, "line_end", 2, None, own)] + [at(frame, "line", 1, name, none) for name, frame in facts.items()]
    upto = Window.partitionBy("path").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, 0)
    summed = reduce(DataFrame.unionByName, events).repartition(parts, "path").withColumns({name: F.count_if(F.col("kind").eqNullSafe(name)).over(upto) for name in facts})
    ends = F.when(F.col("turn") == 2, 1).otherwise(-1)
    return summed.where("turn <> 1").groupBy("path", *keys).agg(*(F.sum(F.col(name) * ends).alias(name) for name in facts))


def enclosing_unit(lines: DataFrame, spans: DataFrame, keys: list[str], one_line: bool = False) -> DataFrame:
    """The smallest span around each line, by width and then id."""
    w = Window.partitionBy(*keys).orderBy(F.col("line_end") - F.col("line_start"), "entity_id")
    return containing(lines, spans, one_line).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def innermost(lines: DataFrame, guards: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Up to ``most`` guards around each line, innermost first, without those on the line itself."""
    w = Window.partitionBy(*keys).orderBy(F.col("line_end") - F.col("line_start"), "entity_id")
    around = containing(lines, guards).where(F.col("line") != F.col("line_start"))
    return around.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= most)


def overlaps(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows (window_id, path, w_start, w_end) with each span they overlap and by how many lines."""
    bins = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("w_start") / BIN), F.floor(F.col("w_end") / BIN))))
    hit = bins.join(_binned(spans), ["path", "_bin"]).where((F.col("w_start") <= F.col("line_end")) & (F.col("line_start") <= F.col("w_end")))
    length = F.least("w_end", "line_end") - F.greatest("w_start", "line_start") + 1
    return hit.drop("_bin").withColumn("overlap", length).dropDuplicates(["window_id", "entity_id"])


def clamp(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans cut to their file's last line."""
    last = lines.groupBy("path").agg(F.max("line").alias("_last"))
    return spans.join(last, "path", "left").withColumn("line_end", F.when(F.col("_last").isNull(), F.col("line_end")).otherwise(F.greatest("line_start", F.least("line_end", "_last")))).drop("_last")


def line_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of consecutive lines."""
    w = Window.partitionBy(*keys).orderBy("line")
    return lines.withColumn("_g", F.col("line") - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def preceding(frame: DataFrame, keys: list[str], order: list[str], mark, value, name: str) -> DataFrame:
    """The last ``value`` of an earlier row for which ``mark`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(w))


def match_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(wanted, path, stage): equal paths, or else the paths that end in the wanted name.

    Both stages are equi-joins: a path is listed under each of its tails.
    """
    exact = wanted.join(files, F.col("wanted") == F.col("path")).select("wanted", "path", F.lit("exact").alias("stage"))
    rest = wanted.join(exact.select("wanted"), "wanted", "left_anti")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    listed = files.where(F.col("path").contains("/")).select("path", F.explode(tails).alias("wanted"))
    return exact.unionByName(rest.join(listed, "wanted").select("wanted", "path", F.lit("suffix").alias("stage")))


def header_before(spans: DataFrame, lines: DataFrame, start: str, most: int) -> DataFrame:
    """Adds ``header``: the nearest of the ``most`` lines before a span that begins with ``start``."""
    reach = F.explode(F.sequence(F.greatest(F.col("line_start") - most, F.lit(1)), F.col("line_start") - 1))
    asked = spans.where("line_start > 1").select("path", "function", "line_start", reach.alias("line"))
    hit = lines.where(F.col("text").startswith(start)).select("path", "line", F.lit(True).alias("hit"))
    return asked.join(hit, ["path", "line"], "left").groupBy("path", "function", "line_start").agg(F.max(F.when(F.col("hit"), F.col("line"))).alias("header"))


def clamp_starts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``body_start``: after the last line of spans that begin earlier, reach in, and end before this one does."""
    mine = spans.withColumn("entity_id", F.concat_ws("#", *keys))
    other = mine.select("path", F.col("line_start").alias("w_start"), F.col("line_end").alias("w_end"), F.col("entity_id").alias("window_id"))
    hit = overlaps(other, mine).where((F.col("w_start") < F.col("line_start")) & (F.col("w_end") < F.col("line_end")))
    floor = hit.groupBy("entity_id").agg((F.max("w_end") + 1).alias("_floor"))
    return mine.join(floor, "entity_id", "left").select(*keys, "line_start", "line_end", F.greatest("line_start", F.coalesce("_floor", F.lit(0))).alias("body_start"))


def restored(lines: DataFrame) -> DataFrame:
    """Lines 1 to the last stored one of each path, the missing ones empty."""
    every = lines.groupBy("path").agg(F.max("line").alias("n")).select("path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    return every.join(lines, ["path", "line"], "left").select("path", "line", F.coalesce("text", F.lit("")).alias("text"))


def window_identity(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """The span that names each window (path, w_start, w_end).

    It is the smallest one around the window's first line if that covers half of the
    window, or else the one with the largest overlap, the shorter of equals.
    """
    keys = ["path", "w_start"]
    named = windows.withColumn("window_id", F.concat_ws("#", "path", "w_start"))
    hit = overlaps(named, spans)
    width = F.col("line_end") - F.col("line_start")
    holds = F.col("w_start").between(F.col("line_start"), F.col("line_end")) & (width > 0)
    of = lambda order: F.min(F.struct(*order, "entity_id", "overlap"))
    best = hit.groupBy(*keys, "w_end").agg(
        F.min(F.when(holds, F.struct(width.alias("w"), "entity_id", "overlap"))).alias("start"), of([(-F.col("overlap")).alias("o"), width.alias("w")]).alias("most"),
    )
    half = (2 * F.col("start.overlap") >= F.col("w_end") - F.col("w_start") + 1) | (F.col("w_end") <= F.col("w_start"))
    chosen = best.select(*keys, F.when(F.col("start").isNotNull() & half, F.col("start.entity_id")).otherwise(F.col("most.entity_id")).alias("entity_id"))
    return windows.join(chosen, keys, "left")
