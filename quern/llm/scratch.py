"""Tables that cut lineage, kept in the folder which the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a temporary folder; on a cluster
    that would not be shared, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    known = getattr(spark.sparkContext, "_quern_scratch", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(known)
        spark.sparkContext._quern_scratch = known
    return known


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Column names for an operator's own use that ``frame`` does not have, whatever their case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """A fresh subfolder of the shared folder for one operator's run.

    ``table`` writes a frame as Parquet and reads it back, so later steps start from
    files that survive the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._stored: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        where = self.path(name)
        writer = frame.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(where)
        back = self.spark.read.schema(frame.schema).parquet(where)
        self._stored[id(back)] = (back, where)
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove stored tables which no plan that is still to run reads."""
        for frame in frames:
            self.delete(self._stored.pop(id(frame))[1])

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)
