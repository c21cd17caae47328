"""Sharding by fixed virtual slots.

Every record hashes to one of ``n_slots`` slots, for good. Bytes are added up per slot
(one row per slot, whatever the table's size), and a small versioned map says which
shard holds each slot. Rebalancing edits that map: it moves whole slots from the
heaviest to the lightest shard until no single move or swap brings the shards closer. A
map kept in a folder is read there by the next run, which edits it for what it measures
and stores the result as the next version, so only the slots that must move do.

Defined cases: a null text counts no bytes (size 1) and has the CRC of no bytes, 0. A
null ``doc_id`` is hashed by its text. ``place`` keeps equal texts in one slot, and so in
one shard, unless their group holds more than half of what a shard should (at most twice
as many groups as shards can); such a group is hashed by id, as no shards of near equal
size could hold it whole. ``assign`` hashes by id alone: the rows that it gets are what
deduplication left, and the repeats that mixing made are to be spread. Within a slot,
rows are numbered part by part (a hash of the id), then by id, CRC and size; rows equal
in all of these are alike. An empty table gives an empty result. Columns of the
input other than the ones named here are ignored by ``place``; ``assign`` keeps them all
and adds its own under the names given, with underscores added if the input has them.
Ids may be of any type that has an order.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, free_names

N_SLOTS = 4096
#: Rows of a slot are numbered in so many parts, so that a slot with a large group is not one task.
PARTS = 16


def slot_of(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a key, or of the text where the key is null; it depends on nothing else."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def even_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 1 of a map: contiguous slot ranges of equal length."""
    return [s * n_shards // n_slots for s in range(n_slots)]


def rebalance(shard_of: list[int], weight: list[int], n_shards: int) -> list[int]:
    """Edit a slot map so that the shards' weights come close.

    Moves go from the heaviest shard to the lightest: the slot nearest to half their
    gap, or else the swap of two slots nearest to it. Each edit lowers the sum of
    squares, so the loop ends.
    """
    shard_of = list(shard_of)
    load = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
        if weight[slot]:
            bisect.insort(held[shard], (weight[slot], slot))

    def nearest(row: list[tuple[int, int]], target: float) -> list[tuple[int, int]]:
        k = bisect.bisect_left(row, (target, -1))
        return row[max(0, k - 1) : k + 1]

    while True:
        high, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best = (gap, None, None)
        for w, slot in nearest(held[high], gap / 2):
            best = min(best, (abs(gap - 2 * w), (w, slot), None), key=lambda x: x[0])
        if 4 * best[0] > gap:
            for give in held[high]:
                for back in nearest(held[low], give[0] - gap / 2):
                    best = min(best, (abs(gap - 2 * (give[0] - back[0])), give, back), key=lambda x: x[0])
        left, give, back = best
        if give is None or left >= gap:
            return shard_of
        for item, src, dst in ((give, high, low), (back, low, high)):
            if item is not None:
                held[src].remove(item)
                bisect.insort(held[dst], item)
                load[src] -= item[0]
                load[dst] += item[0]
                shard_of[item[1]] = dst


class SlotMap:
    """A versioned slot-to-shard map: a Parquet table with a partition of ``n_slots`` rows per version."""

    def __init__(self, spark: SparkSession, folder: str, n_shards: int, n_slots: int = N_SLOTS):
        self.spark, self.folder, self.n_shards, self.n_slots = spark, folder, n_shards, n_slots
        self.version, self.shard_of = 0, even_map(n_slots, n_shards)
        self._load()

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _load(self) -> None:
        """Take the last stored version, if there is one, as the map to edit."""
        if not self._exists():
            return
        stored = self.spark.read.parquet(self.folder)
        last = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == last).select("vslot", "shard").collect()
        if len(rows) != self.n_slots or any(r.shard >= self.n_shards for r in rows):
            raise ValueError(f"{self.folder}: version {last} is no map of {self.n_slots} slots to {self.n_shards} shards")
        self.version, self.shard_of = last, [r.shard for r in sorted(rows)]

    def commit(self, shard_of: list[int], rows: list[int]) -> DataFrame:
        """Store the next version; ``first_slot_row`` numbers the rows of a shard slot by slot."""
        self.version, self.shard_of = self.version + 1, list(shard_of)
        seen, table = [0] * self.n_shards, []
        for vslot, shard in enumerate(shard_of):
            table.append((vslot, shard, seen[shard], self.version))
            seen[shard] += rows[vslot]
        frame = self.spark.createDataFrame(table, "vslot int, shard int, first_slot_row long, version int")
        frame.coalesce(1).write.partitionBy("version").mode("append").parquet(self.folder)
        return self.spark.read.schema(frame.schema).parquet(self.folder).where(F.col("version") == self.version)

    def rebalanced(self, per_slot: DataFrame) -> DataFrame:
        """Edit the map for measured slots; at most ``n_slots`` rows come to the driver."""
        weight, rows = [0] * self.n_slots, [0] * self.n_slots
        for r in per_slot.collect():
            weight[r.vslot], rows[r.vslot] = r.n_bytes, r.n_rows
        return self.commit(rebalance(self.shard_of, weight, self.n_shards), rows)


def measured(keyed: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, summed before the shuffle."""
    return keyed.groupBy("vslot").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))


def large_groups(sized: DataFrame, n_shards: int) -> list[int]:
    """Text hashes whose rows weigh more than half a shard: at most ``2 * n_shards`` values."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    groups = sized.groupBy("text_hash").agg(F.sum("size").alias("n_bytes"))
    return [r.text_hash for r in groups.where(F.col("n_bytes") * (2 * n_shards) > total).collect()]


def place(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, maps: str | None = None) -> DataFrame:
    """One row per document with its shard and its place in that shard; equal texts together (see above).

    ``maps`` is the folder of the slot map's versions, a fresh one if not given.

    The text is read once, for its size, CRC and hash; only those and the key are stored
    and shuffled. Row numbers come from a window within a part of a virtual slot plus the
    part's first row in its shard, so no task holds a whole shard or slot.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = scratch.table(docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "sized")
    spread = F.col("text_hash").isin(large_groups(sized, n_shards)) & F.col("doc_id").isNotNull()
    by_text, by_id = (F.pmod(h, F.lit(n_slots)).cast("int") for h in (F.col("text_hash"), F.xxhash64("doc_id")))
    keyed = sized.withColumn("vslot", F.when(spread, by_id).otherwise(by_text)).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
    parts = scratch.table(keyed.groupBy("vslot", "part").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")), "parts")
    per_slot = parts.groupBy("vslot").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
    slot_map = SlotMap(docs.sparkSession, maps or scratch.path("slot-maps"), n_shards, n_slots).rebalanced(per_slot)
    before = F.sum("n_rows").over(_in_slot("part")) - F.col("n_rows")
    # At most n_slots * PARTS rows, whatever the table's size.
    firsts = parts.withColumn("before", before).join(F.broadcast(slot_map), "vslot").select("vslot", "part", "shard", "version", (F.col("first_slot_row") + F.col("before")).alias("first"))
    return (
        keyed.withColumn("row", F.row_number().over(_in_part()))
        .join(F.broadcast(firsts), ["vslot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("row") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
        )
    )


def _in_slot(*order: str):
    return Window.partitionBy("vslot").orderBy(*order)


def _in_part():
    return Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")


def assign(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, shard: str = "shard", vslot: str = "vslot", maps: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus shard and virtual slot, without shuffling texts."""
    scratch = Scratch(docs.sparkSession, "sharding")
    slot = slot_of(F.col("doc_id"), F.col("text"), n_slots)
    keyed = docs.select(record_size(F.col("text")).alias("size"), slot.alias("vslot"))
    slot_map = SlotMap(docs.sparkSession, maps or scratch.path("slot-maps"), n_shards, n_slots).rebalanced(measured(keyed))
    shard, vslot = (n[1:] for n in free_names(docs.select(*(F.lit(None).alias(f"_{c}") for c in docs.columns)), shard, vslot))
    names = slot_map.select(F.col("vslot").alias(vslot), F.col("shard").alias(shard))
    return docs.withColumn(vslot, slot).join(F.broadcast(names), vslot).select(*(f"`{c}`" for c in docs.columns), vslot, shard)
