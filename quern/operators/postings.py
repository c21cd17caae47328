"""Coverage queries over (key, dim, value) postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import TRUTHS, truth_aliases
from quern.functions.source_text import worth_sharing
from quern.sources.staging import stage

def matches(filters: dict[str, str]) -> Column:
    """Whether a posting meets a filter; a truth value is met in any spelling."""
    out = F.lit(False)
    for dim, value in filters.items():
        out = out | ((F.col("dim") == dim) & F.col("value").isin(*truth_aliases(value)))
    return out


def intersection(dims: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Keys that meet every filter."""
    return dims.where(matches(filters)).groupBy("key_id").agg(F.count_distinct("dim").alias("n")).where(F.col("n") == len(filters)).select("key_id")


def nearby(dims: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Per filter left out: how many keys meet the others, and the values its dim has there.

    A lone filter leaves no other to meet: its total is 0, its values are all that the dim has.
    """
    if len(filters) == 1:
        (dim,) = filters
        return dims.where(F.col("dim") == dim).groupBy(F.col("dim").alias("dropped")).agg(F.lit(0).cast("long").alias("total"), F.sort_array(F.collect_set("value")).alias("values"))
    hit = dims.where(matches(filters)).select("key_id", F.col("dim").alias("met")).distinct()
    per_key = hit.groupBy("key_id").agg(F.collect_set("met").alias("met"))
    dropped = per_key.withColumn("dropped", F.explode(F.array(*map(F.lit, filters))))
    others = dropped.where(F.size(F.array_except("met", F.array("dropped"))) == len(filters) - 1)
    values = others.join(dims, (others["key_id"] == dims["key_id"]) & (F.col("dropped") == F.col("dim")))
    return values.groupBy("dropped").agg(F.count_distinct(others["key_id"]).alias("total"), F.sort_array(F.collect_set("value")).alias("values"))


def cross_counts(dims: DataFrame, dim: str, value: str) -> DataFrame:
    """Keys per (other dim, value) among those with dim = value, zeros included."""
    keys = dims.where((F.col("dim") == dim) & (F.col("value") == value)).select("key_id").distinct()
    universe = dims.where(F.col("dim") != dim).select("dim", "value").distinct()
    found = dims.join(keys, "key_id", "left_semi").groupBy("dim", "value").agg(F.count_distinct("key_id").alias("n"))
    return universe.join(found, ["dim", "value"], "left").select("dim", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pair_grid(dims: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for every pair of values of two dims, zero cells included.

    The cells come from the two value domains, exploded, not from a join of keys.
    """
    one = dims.where(F.col("dim") == a).select("key_id", F.col("value").alias("value_a"))
    two = dims.where(F.col("dim") == b).select("key_id", F.col("value").alias("value_b"))
    found = one.join(two, "key_id").groupBy("value_a", "value_b").agg(F.count(F.lit(1)).alias("n"))
    domains = dims.agg(F.collect_set(F.when(F.col("dim") == a, F.col("value"))).alias("va"), F.collect_set(F.when(F.col("dim") == b, F.col("value"))).alias("vb"))
    cells = domains.select(F.explode("va").alias("value_a"), "vb").select("value_a", F.explode("vb").alias("value_b"))
    return cells.join(found, ["value_a", "value_b"], "left").select("value_a", "value_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _pinned(values: Column) -> Column:
    """One spelling for a filtered dim: 0 or 1 if it is there, else the first."""
    stored = F.filter(values, lambda v: v.isin("0", "1"))
    return F.slice(F.when(F.size(stored) > 0, stored).otherwise(values), 1, 1)


def cover(blocks: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Values per dim over the blocks (block_id, dim, value) that meet every filter; a filtered dim has the one it is pinned to."""
    hit = blocks.where(matches(filters)).groupBy("block_id").agg(F.count_distinct("dim").alias("n")).where(F.col("n") == len(filters)) if filters else blocks
    own = F.lit(True)
    for dim, value in filters.items():
        own = own & ((F.col("dim") != dim) | F.col("value").isin(*truth_aliases(value)))
    found = blocks.join(hit, "block_id", "left_semi").where(own).groupBy("dim").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return found.withColumn("values", F.when(F.col("dim").isin(*filters), _pinned(F.col("values"))).otherwise(F.col("values")) if filters else F.col("values"))


#: Blocks whose membership is one number.
WORD = 64


def block_sets(blocks: DataFrame) -> DataFrame:
    """(dim, value, word, bits): the blocks of each value as bit sets, ``WORD`` blocks to a number."""
    numbers = stage(blocks.select("block_id").distinct().withColumn("i", F.monotonically_increasing_id()), "numbers")
    at = F.expr(f"shiftleft(1L, cast(i % {WORD} as int))")
    return blocks.join(numbers, "block_id").groupBy("dim", "value", F.floor(F.col("i") / WORD).alias("word")).agg(F.bit_or(at).alias("bits"))


def covers(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, dropped, blocks, dim, values) for all requests (request, dim, value) at once.

    A request whose filters some blocks meet has the values of every dim over these, a
    filtered dim pinned to one spelling; ``dropped`` is empty. Of another, each filter is
    left out in turn: how many blocks meet the others, and the values that its dim has
    there. A request names a dim once; its first value by order counts if it does not.
    """
    sets = stage(block_sets(blocks), "sets")
    filters = asked.groupBy("request", "dim").agg(F.min("value").alias("value"))
    said = F.trim("value")
    spelled = F.array(F.col("value"))
    for t in TRUTHS:
        spelled = F.when(said.isin(*t) | (F.lower(said) == t[1]), F.array(*map(F.lit, t))).otherwise(spelled)
    wanted = filters.select("request", "dim", F.explode(F.array_union(spelled, F.array("value"))).alias("value"))
    size = filters.groupBy("request").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("dim")).alias("dims"))
    met = wanted.join(sets, ["dim", "value"]).groupBy("request", "dim", "word").agg(F.bit_or("bits").alias("bits"))
    held = met.groupBy("request", "word").agg(F.collect_list(F.struct("dim", "bits")).alias("held")).join(size, "request")
    each = held.select("request", "word", "held", "k", F.explode(F.concat(F.array(F.lit("")), "dims")).alias("dropped"))
    rest = F.filter("held", lambda x: x["dim"] != F.col("dropped"))
    full = each.withColumn("rest", rest).where((F.size("rest") == F.col("k") - (F.col("dropped") != "").cast("int")) & (F.size("rest") > 0))
    some = full.select("request", "dropped", "word", F.aggregate("rest", F.lit(-1).cast("long"), lambda a, x: a.bitwiseAND(x["bits"])).alias("own"))
    subsets = stage(some.where("own <> 0"), "subsets")
    counts = subsets.groupBy("request", "dropped").agg(F.sum(F.bit_count("own")).alias("blocks"))
    met_all = counts.where("dropped = ''").select("request")
    shown = (F.col("dropped") == "") | (F.col("dropped") == F.col("dim"))
    values = subsets.join(sets, "word").where(shown & (F.col("own").bitwiseAND(F.col("bits")) != 0)).select("request", "dropped", "dim", "value").distinct()
    # Of a filtered dim only what the filter asks for.
    own = wanted.select("request", "dim", "value", F.lit(True).alias("own"))
    pins = filters.select("request", "dim", F.lit(True).alias("pin"))
    kept = values.join(pins, ["request", "dim"], "left").join(own, ["request", "dim", "value"], "left").where("dropped <> '' OR pin IS NULL OR own")
    listed = kept.groupBy("request", "dropped", "dim").agg(F.sort_array(F.collect_set("value")).alias("values"), F.max(F.coalesce("pin", F.lit(False))).alias("pin"))
    pinned = listed.withColumn("values", F.when(F.col("pin") & (F.col("dropped") == ""), _pinned(F.col("values"))).otherwise(F.col("values")))
    whole = counts.where("dropped = ''").join(pinned, ["request", "dropped"]).select("request", "dropped", "blocks", "dim", "values")
    none = F.array().cast("array<string>")
    near = counts.where("dropped <> ''").join(met_all, "request", "left_anti").join(pinned.drop("pin"), ["request", "dropped"], "left")
    near = near.select("request", "dropped", "blocks", F.col("dropped").alias("dim"), F.coalesce("values", none).alias("values"))
    # A lone filter left out leaves all blocks.
    total = sets.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sum(F.bit_count("bits")).alias("blocks")).where("blocks > 0")
    of_dim = sets.groupBy("dim").agg(F.sort_array(F.collect_set("value")).alias("values"))
    lone = size.where("k = 1").join(met_all, "request", "left_anti").select("request", F.col("dims")[0].alias("dropped")).join(F.broadcast(total))
    lone = lone.join(of_dim, F.col("dropped") == F.col("dim"), "left").select("request", "dropped", "blocks", F.col("dropped").alias("dim"), F.coalesce("values", none).alias("values"))
    return whole.unionByName(near).unionByName(lone)


def pack(fields: list[tuple[Column, int]]) -> Column:
    """Bit-pack (value, width) fields, first lowest; 63 bits at most."""
    if sum(w for _, w in fields) > 63:
        raise ValueError("packed key is wider than 63 bits")
    out, shift = F.lit(0).cast("long"), 0
    for value, width in fields:
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), shift))
        shift += width
    return out


def unpack(key: Column, shift: int, width: int) -> Column:
    return F.shiftright(key, shift).bitwiseAND(F.lit((1 << width) - 1))


def legal_instances(groups: DataFrame, dims: list[str]) -> DataFrame:
    """The product of each group's domains, one explode per dim."""
    out = groups
    for d in dims:
        out = out.withColumn(d, F.explode(d))
    return out


def sharing(rows: DataFrame, key: str, ints: str, expr: str) -> DataFrame:
    """(a, b, common): pairs of expressions whose common integers are worth sharing.

    Pairs meet under a telling integer, or as lists under any; 0 and 1 alone join no
    scalars, so the commonest values make no pairs of them.
    """
    listed = F.col(expr).contains("{")
    posted = rows.select(F.col(key).alias("k"), F.col(expr).alias("e"), F.col(ints).alias("v"), listed.alias("list"), F.explode(ints).alias("x"))
    posted = posted.where(F.col("list") | ~F.col("x").isin(0, 1))
    one, two = (posted.select(*(F.col(c).alias(f"{c}_{s}") for c in ("k", "e", "v")), "x") for s in ("a", "b"))
    pairs = one.join(two, "x").where("k_a < k_b").dropDuplicates(["k_a", "k_b"])
    common = F.sort_array(F.array_intersect("v_a", "v_b"))
    return pairs.where(worth_sharing(common, F.col("e_a"), F.col("e_b"))).select(F.col("e_a").alias("a"), F.col("e_b").alias("b"), common.alias("common"))


def covered(rows: DataFrame, mask: str, dims: dict[str, int]) -> DataFrame:
    """Rows with each dim whose bits their mask holds whole; the dims are a constant list."""
    held = F.filter(F.array(*(F.when(F.col(mask).bitwiseAND(F.lit(bits)) == bits, F.lit(name)) for name, bits in dims.items())), lambda x: x.isNotNull())
    return rows.withColumn("dim", F.explode(held))


def support(dims: DataFrame, dim: str, value: str) -> DataFrame:
    """(fact, dim, value, n): counts of the dim's values, of other values beside this one with zeros, and without it."""
    keys = dims.where((F.col("dim") == dim) & (F.col("value") == value)).select("key_id").distinct()
    own = dims.where(F.col("dim") == dim).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    rest = dims.where(F.col("dim") != dim).join(keys, "key_id", "left_anti").groupBy("dim", "value").agg(F.count_distinct("key_id").alias("n"))
    facts = {"value": own, "cross": cross_counts(dims, dim, value), "without": rest}
    parts = [frame.select(F.lit(name).alias("fact"), "dim", "value", "n") for name, frame in facts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
