"""Name cards for any number of requests: the symbol a name means, and what is known of it.

A name is looked up in stages, and the first that finds anything answers: the whole name,
its last part with the owners compared, a prefix, any part of a name. Case is ignored.
The first two are joins by the last part; only names they leave open go on, through the
rarest gram of each, so no stage lists requests against all symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import leaf
from quern.sources.staging import stage

EXACT, OWNER, PREFIX, RECALL = 0, 1, 2, 3
#: What the stages are called, in their order.
STAGES = ["exact", "owner", "prefix", "recall"]


def owners(name: Column) -> Column:
    """Qualifiers of a name, nearest first: ``A::B::run`` has B, A."""
    parts = F.split(F.replace(F.lower(name), F.lit("."), F.lit("::")), "::")
    return F.reverse(F.slice(parts, 1, F.size(parts) - 1))


def shared_owners(a: Column, b: Column) -> Column:
    """How many qualifiers agree, counted from the nearest."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def grams(text: Column, n: int) -> Column:
    """The different parts of ``n`` characters."""
    last = F.char_length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def hits(needles: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, id, stage, rank): for each needle, the symbols of its first stage with any; ``rank`` are the owners shared."""
    low = symbols.where("name IS NOT NULL").select("id", F.col("name").alias("full"), F.lower("name").alias("low"), F.lower(leaf(F.col("name"))).alias("part"))
    asked = needles.where("name IS NOT NULL AND name <> ''").select("name", F.lower("name").alias("q"), F.lower(leaf(F.col("name"))).alias("part")).distinct()
    named = asked.join(low, "part").withColumn("stage", F.when(F.col("low") == F.col("q"), EXACT).otherwise(OWNER)).withColumn("rank", shared_owners(owners(F.col("name")), owners(F.col("full"))))
    near = stage(named.select("name", "id", "stage", "rank"), "named")
    open_ = stage(asked.join(near.select("name").distinct(), "name", "left_anti").select("name", "q"), "open")
    sized = open_.select("name", "q", F.explode(grams(F.col("q"), 3)).alias("gram")).unionByName(open_.where(F.char_length("q") < 3).select("name", "q", F.col("q").alias("gram")))
    # Grams of one and two characters are listed only where a needle is that short.
    wanted = sized.select("gram").distinct()
    listed = F.concat(grams(F.col("low"), 1), grams(F.col("low"), 2), grams(F.col("low"), 3))
    posted = low.select("id", "low", "part", F.explode(listed).alias("gram")).join(wanted, "gram", "left_semi")
    posted = stage(posted, "posted")
    n = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = sized.join(n, "gram", "left").groupBy("name", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("name", "q", "g.gram")
    starts = F.startswith("low", "q") | F.startswith("part", "q")
    found = rarest.join(posted, "gram").where(F.contains("low", "q")).select("name", "id", F.when(starts, PREFIX).otherwise(RECALL).alias("stage"), F.lit(0).alias("rank"))
    every = near.unionByName(found)
    first = every.groupBy("name").agg(F.min("stage").alias("stage"))
    return every.join(first, ["name", "stage"]).select("name", "id", "stage", "rank")


def facts(edges: DataFrame) -> DataFrame:
    """Per symbol: callers, callees, writers and readers, and the caller with most sites, then least id."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    best = F.min(F.when(F.col("kind") == "CALLS", F.struct((-F.col("n_sites")).alias("n"), "src"))).alias("best")
    into = edges.groupBy(F.col("dst").alias("id")).agg(n("CALLS").alias("callers"), n("WRITES").alias("writers"), n("READS").alias("readers"), best)
    out = edges.groupBy(F.col("src").alias("id")).agg(n("CALLS").alias("callees"))
    counts = ["callers", "callees", "writers", "readers"]
    return into.join(out, "id", "full").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.col("best.src").alias("top_caller"))


def cards(asked: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (request, name): the stage that answered, how many symbols it has, and the card of the first.

    The first has most owners in common, then the least id; ``ambiguous`` if others have as
    many. A name that nothing answers has stage ``none``; a null or empty name too.
    """
    found = hits(asked.select("name"), symbols)
    top = found.groupBy("name", "stage").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct((-F.col("rank")).alias("rank"), "id")).alias("first"), F.max("rank").alias("best"))
    level = found.groupBy("name", "rank").agg(F.count(F.lit(1)).alias("n"))
    tied = top.join(level.withColumnRenamed("rank", "best"), ["name", "best"]).select("name", "stage", "hits", F.col("first.id").alias("id"), (F.col("n") > 1).alias("ambiguous"))
    kinds = symbols.select("id", "kind", "file", "line_start")
    whole = tied.join(kinds, "id").join(facts(edges), "id", "left").na.fill(0, ["callers", "callees", "writers", "readers"])
    label = F.coalesce(F.get(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit("none"))
    got = asked.select("request", "name").join(whole, "name", "left")
    return got.select("request", "name", label.alias("stage"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "id", "kind", "file", "line_start", "callers", "callees", "writers", "readers", "top_caller")
