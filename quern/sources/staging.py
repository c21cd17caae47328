"""Lineage cuts for iterative plans: Parquet in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    root = getattr(spark.sparkContext, "_quern_staging", None) or tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext._quern_staging = root
    return root


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """The session's setting within the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_bucket(spark: SparkSession):
    """Within the block a task reads one bucket. By size alone Spark packs many small ones into a task, too few and too uneven tasks for what is read by Python."""
    return setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    where = f"{shared_root(frame.sparkSession)}/stage-{uuid.uuid4().hex}/{name}"
    with by_bucket(frame.sparkSession):
        frame.write.parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


@contextmanager
def bucketed(frame: DataFrame, name: str, by: list[str], buckets: int | None = None, deal: bool = True) -> Iterator[DataFrame]:
    """A copy of ``frame`` dealt and sorted by ``by``, so that joins on these columns do not deal it anew.

    Without ``deal`` the rows are as a window or group by these columns left them.

    It is known to the session's catalogue only within the block; what is to stay must be staged there.
    """
    spark = frame.sparkSession
    known = f"{name}_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (frame.repartition(n, *by) if deal else frame).write.bucketBy(n, *by).sortBy(*by).format("parquet")
    writer.option("path", f"{shared_root(spark)}/{known}").saveAsTable(known)
    try:
        yield spark.table(known)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {known}")
