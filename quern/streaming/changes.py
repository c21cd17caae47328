"""Structured Streaming forms of the update operators (extensions of the batch ones).

``merge_changes`` keeps the latest content hash of each path by merging micro-batches
into a table whose versions share what did not change; ``open_flags`` pairs set and wait events per key with
event-time windows and a watermark; ``distinct_sites`` drops repeated observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.sources.staging import stage
from quern.sources.versions import Versions


def merge_changes(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Fold (path, sha, seq) rows into the versions under ``root``; a batch rewrites the buckets of its paths.

    The version remembers the last batch of a checkpoint, so a batch that is run again
    changes nothing. A fresh checkpoint goes on from the current version, and a fresh root
    starts empty, whatever the checkpoint's next batch.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = Versions(spark, root, "path")
        rows = batch.select("path", "sha", "seq")
        if table.manifest()[0]:
            rows = rows.unionByName(table.read().join(rows.select("path").distinct(), "path", "left_semi"))
        newest = stage(rows.groupBy("path").agg(F.max_by("sha", "seq").alias("sha"), F.max("seq").alias("seq")), "newest")
        table.apply(newest, batch=(checkpoint, batch_id))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, root: str) -> DataFrame:
    return Versions(spark, root, "path").read()


def distinct_sites(stream: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def open_flags(stream: DataFrame, key: str, role: str, time: str, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Sets and waits per key and window; paired where both are found."""
    n = lambda r: F.count_if(F.col(role) == r)
    grouped = stream.withWatermark(time, lateness).groupBy(key, F.window(time, window))
    return grouped.agg(n("set").alias("sets"), n("wait").alias("waits")).withColumn("paired", (F.col("sets") > 0) & (F.col("waits") > 0))


def batch_twin(rows: DataFrame) -> DataFrame:
    """What ``merge_changes`` must end with, from all rows at once."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
