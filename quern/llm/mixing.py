"""Mixing sources to target weights by the cube method.

Each source gets a target number of words; a document's expected number of copies is
its source's target over its size, at most 2. The whole part is taken for sure. The
fractional part is an inclusion probability, and the cube method turns it into 0 or 1:
the flight phase moves the probabilities of three documents at a time along the null
space of two constraints, the number of documents and the number of words, until one
of them is 0 or 1, with a random sign that keeps every probability's mean. At most two
fractions stay in a block.

Blocks are hash parts of a source with about ``BLOCK`` documents, so a source of any
size is many tasks; what stays fractional in the blocks of a level is the input of the
next level, a thousand times smaller, until one block a source is left. Its last
fractions and a reserve of ten are the landing problem: of their roundings, the one
nearest to the words that the fractions stand for. All random choices are seeded by source, block and level:
reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, after the
others; documents of a source without any words take 0; repeated rows are separate
documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, free_names

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
BLOCK = 2000
#: Documents of a source's last block that are left to the landing besides the flight's two.
RESERVE = 10
#: Up to so many sources, their table of targets is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 10_000
EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def with_targets(sources: DataFrame, budget: float = BUDGET, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with src, their place by code point, and target.

    Shares by weight are cut at ``most`` sizes and the excess is shared again. Only one
    number, the target of weight 1, goes from round to round; the sources stay a table.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("src", place).withColumn("_weight", weight)
    total, unit, cut = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.lit(unit) * F.col("_weight") > most * F.col("source_size")
        r = weighed.agg(F.sum(above.cast("long")).alias("cut"), F.sum(F.when(above, F.col("source_size"))).alias("size"), F.sum(F.when(~above, F.col("_weight"))).alias("weight")).first()
        if r.cut == cut or not r.weight:
            break
        cut, unit = r.cut, (budget * total - most * (r.size or 0)) / r.weight
    above = (F.lit(unit) * F.col("_weight") > most * F.col("source_size")) | F.lit(not r.weight)
    return weighed.withColumn("target", F.when(above, most * F.col("source_size")).otherwise(unit * F.col("_weight"))).drop("_weight")


def flight(sizes: list[int], chance: list[float], rng: random.Random, reserve: int = 0) -> list[float]:
    """Move probabilities to 0 or 1, keeping their sum and their sum weighted by size.

    At most two entries stay between 0 and 1, and ``reserve`` more, taken evenly from
    all sizes, which do not fly: they make the landing's roundings fine-grained.
    """
    x = list(chance)
    open_ = sorted((i for i in range(len(x)) if EPS < x[i] < 1 - EPS), key=lambda i: (-sizes[i], i))
    held = {open_[len(open_) * k // reserve] for k in range(reserve)} if open_ else set()
    waiting = iter([i for i in open_ if i not in held])
    active = list(itertools.islice(waiting, 3))
    while len(active) == 3:
        a, b, c = active
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(u):
            u = (1, -1, 0)
        up, down = float("inf"), float("inf")
        for i, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - x[i]) / d), min(down, x[i] / d)
            elif d < 0:
                up, down = min(up, x[i] / -d), min(down, (1 - x[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for i, d in zip(active, u, strict=True):
            x[i] += step * d
            if x[i] <= EPS or x[i] >= 1 - EPS:
                x[i] = float(round(x[i]))
            else:
                still.append(i)
        active = still + list(itertools.islice(waiting, 3 - len(still)))
    return x


def land(sizes: list[int], chance: list[float]) -> list[float]:
    """Round the last fractions so that the words are nearest to what they stand for."""
    open_ = [i for i, v in enumerate(chance) if EPS < v < 1 - EPS]
    want = sum(chance[i] * sizes[i] for i in open_)
    count = sum(chance[i] for i in open_)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_)),
        key=lambda pick: (abs(sum(p * sizes[i] for p, i in zip(pick, open_, strict=True)) - want), abs(sum(pick) - count), pick),
    )
    x = [float(round(v)) for v in chance]
    for p, i in zip(best, open_, strict=True):
        x[i] = p
    return x


def _level(units: DataFrame, level: int, salt: int) -> DataFrame:
    """One flight over (unit, src, size, x), in blocks of at most about ``BLOCK`` units."""

    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "size"], kind="stable", na_position="last").reset_index(drop=True)
        sizes, x = rows["size"].tolist(), rows["x"].tolist()
        last = rows["n_blocks"].iloc[0] == 1
        x = flight(sizes, x, random.Random(f"{salt}/{level}/{key[0]}/{key[1]}"), RESERVE if last else 0)
        rows["x"] = land(sizes, x) if last else x
        return rows[["doc_id", "unit", "src", "size", "x"]]

    kinds = dict(units.dtypes)
    block = F.pmod(F.xxhash64("unit", F.lit(level)), F.col("n_blocks"))
    return units.withColumn("block", block).groupBy("src", "block").applyInPandas(fly, f"doc_id {kinds['doc_id']}, unit long, src int, size long, x double")


def _with(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if few else table, "src")


def _mix(docs: DataFrame, salt: int, name: str) -> tuple[DataFrame, Scratch]:
    """doc_id, unit, size, source_size, target, copies: one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    sized = scratch.table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), unit_key(docs).alias("unit")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    by_source = with_targets(scratch.table(by_source, "sources")).withColumn("ratio", ratio).withColumn("base", F.floor(F.col("ratio") + EPS).cast("int"))
    n_blocks = F.ceil(F.col("n") / BLOCK).alias("n_blocks")
    by_source = scratch.table(by_source.select("src", "source", "source_size", "target", "base", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)).alias("x"), n_blocks), "targets")
    few = by_source.count() <= BROADCAST_SOURCES
    named = by_source.withColumnRenamed("source", "_source")
    units = sized.join(F.broadcast(named) if few else named, sized["source"].eqNullSafe(named["_source"])).select("doc_id", "unit", "src", "size", "x", "n_blocks")

    settled: list[DataFrame] = []
    blocks, level = by_source, 0
    while True:
        most_blocks = blocks.agg(F.max("n_blocks")).first()[0] or 0
        if level and not most_blocks:
            break
        done = scratch.table(_level(units, level, salt), f"level{level}")
        fraction = (F.col("x") > EPS) & (F.col("x") < 1 - EPS)
        settled.append(done.where(~fraction))
        if most_blocks <= 1:
            break
        blocks = scratch.table(done.where(fraction).groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", n_blocks), f"blocks{level}")
        units = _with(done.where(fraction), blocks, few).select("doc_id", "unit", "src", "size", "x", "n_blocks")
        level += 1

    picked = settled[0]
    for more in settled[1:]:
        picked = picked.unionByName(more)
    out = _with(picked, by_source.select("src", "source_size", "target", "base"), few)
    return out.select("doc_id", "unit", "size", "source_size", "target", (F.col("base") + F.round("x").cast("int")).alias("copies")), scratch


def unit_key(docs: DataFrame) -> Column:
    """A key of a document's content; equal rows share it and are told apart by their rank."""
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))


def mix(docs: DataFrame, salt: int = 0) -> DataFrame:
    """How many words the mix takes of each document."""
    out, _ = _mix(docs, salt, "mixing")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, salt: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns as they were."""
    copies, _ = _mix(docs, salt, "mixing")
    unit, size, low, more, rank, again = free_names(docs, "unit", "size", "low", "more", "rank", "again")
    per = copies.groupBy(F.col("unit").alias(unit), F.col("size").alias(size))
    # Of equal rows some may be taken once more than others: the first ones.
    per = per.agg(F.min("copies").alias(low), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias(more)).where((F.col(low) > 0) | (F.col(more) > 0))
    keyed = docs.withColumn(unit, unit_key(docs)).withColumn(size, n_words(F.col("text"))).join(per, [unit, size])
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(unit, size).orderBy(F.lit(1))))
    n = F.col(low) + (F.col(rank) <= F.col(more)).cast("int")
    taken = ranked.withColumn(again, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    return taken.select(*(f"`{c}`" for c in docs.columns))
