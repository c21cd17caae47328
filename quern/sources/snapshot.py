"""Stored snapshots: the tables of one graph, written once and read by every query.

A snapshot is a folder with one Parquet table per name and a ``meta`` table of (key,
value) rows. Tables are dealt and sorted by the column that lookups filter on, so a point
lookup reads the row groups whose range holds the key. A writer fills a folder of its own
and then names it under the next number in ``current``; the greatest number is the
current version, so readers see the old version or the new one and never a part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import numbered
from quern.sources.numbered import hadoop
from quern.sources.staging import by_bucket, setting, shared_root

SCHEMA = "quern/2"
#: Rows of a table per bucket of what is derived from it: a task then sorts about 100 MB of text.
BUCKET_ROWS = 100_000
_STORED: dict[tuple[str, str, str], tuple[str, object, str]] = {}
_COUNTED: dict[tuple[str, str, str], tuple[int, str]] = {}


def _sorted(frame: DataFrame, key: str | None) -> DataFrame:
    """Rows dealt by ``key`` and sorted by it in each file; a key that very many rows have is split over files."""
    return frame.hint("rebalance", F.col(key)).sortWithinPartitions(key) if key else frame


def source_state(spark: SparkSession, source: str) -> str:
    """A digest of the names, sizes and times of the files below ``source``, which change with its tables."""
    fs, target = hadoop(spark, source)
    if not fs.exists(target):
        return ""
    found, seen = fs.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def _open_folders(spark: SparkSession, most: int = 256):
    """Tasks keep a file open in each folder or bucket, fewer than ``most``, and so need not sort their rows by it."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", most)


def lookup_table(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], sort: str | None = None, parts: str | None = None, deal: bool = True) -> DataFrame:
    """The table ``name`` derived from ``source``, built at its first use in the session and anew when the source's files change.

    With ``parts`` each value of that column has a folder of its own. Without ``deal``
    rows stay in the partitions they are built in and are sorted there, or with ``parts``
    written to their folders in the order they come, as builders sort runs of them.
    """
    key, state = (spark.sparkContext.applicationId, source, name), source_state(spark, source)
    if key not in _STORED or _STORED[key][2] != state:
        where = f"{shared_root(spark)}/snapshot-{uuid.uuid4().hex}/{name}"
        frame = build()
        if parts and deal:
            dealt = frame.repartition(parts).sortWithinPartitions(parts, sort)
            with by_bucket(spark):
                dealt.write.option("compression", "zstd").partitionBy(parts).parquet(where)
        elif parts:
            with _open_folders(spark), by_bucket(spark):
                frame.write.option("compression", "zstd").partitionBy(parts).parquet(where)
        else:
            kept = _sorted(frame, sort) if deal or not sort else frame.sortWithinPartitions(sort)
            with by_bucket(spark):
                kept.write.option("compression", "zstd").parquet(where)
        _STORED[key] = (where, frame.schema, state)
    where, schema, _ = _STORED[key]
    return spark.read.schema(schema).parquet(where)


def buckets(spark: SparkSession, source: str, name: str) -> int:
    """Buckets for what is derived from the table ``name``: as many as the session's shuffles have, or more so that none takes over ``BUCKET_ROWS`` of its rows."""
    key, state = (spark.sparkContext.applicationId, source, f"rows of {name}"), source_state(spark, f"{source}/{name}.parquet")
    if key not in _COUNTED or _COUNTED[key][1] != state:
        _COUNTED[key] = (spark.read.parquet(f"{source}/{name}.parquet").count(), state)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_COUNTED[key][0] // BUCKET_ROWS))


def bucket_table(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: str, *sort: str, n: int | None = None) -> DataFrame:
    """Like ``lookup_table``, in buckets by ``by``: windows, groups and lookups by this column move no row.

    ``build`` is to return rows that are dealt by ``by`` to ``n`` partitions, the session's
    number if not given, as operators over other tables in such buckets do; others get more
    files. Rows are sorted in their bucket if ``sort`` names columns; without, they are
    written in the order they come, and none is held back.
    """
    key, state = (spark.sparkContext.applicationId, source, name), source_state(spark, source)
    if key not in _STORED or _STORED[key][2] != state:
        known, frame = f"{name}_{uuid.uuid4().hex}", build()
        writer = frame.write.format("parquet").option("compression", "zstd").option("path", f"{shared_root(spark)}/{known}")
        writer = writer.bucketBy(n or int(spark.conf.get("spark.sql.shuffle.partitions")), by)
        with _open_folders(spark), by_bucket(spark):
            (writer.sortBy(*sort) if sort else writer).saveAsTable(known)
        _STORED[key] = (known, frame.schema, state)
    return spark.table(_STORED[key][0])


def forget(spark: SparkSession) -> None:
    """Build the session's tables anew at their next use, as after a change of the sources."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]


# -- whole snapshots ------------------------------------------------------------------


def write(root: str, tables: dict[str, DataFrame], meta: dict[str, str], sort: dict[str, str] | None = None) -> str:
    """Write the next version of the snapshot under ``root`` and make it current."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        key = (sort or {}).get(name)
        _sorted(frame, key).write.parquet(f"{root}/{version}/{name}")
    write_meta(spark, f"{root}/{version}", {"schema": SCHEMA, "version": version, **meta})
    numbered.append(spark, f"{root}/current", version)
    return version


def write_meta(spark: SparkSession, folder: str, meta: dict[str, str]) -> None:
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop(spark, path)
    return fs.exists(target)


class Snapshot:
    """An open version; it stays readable and unchanged while newer ones are written."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.root = spark, root
        if version is None:
            found = numbered.last(spark, f"{root}/current")
            if found is None:
                raise FileNotFoundError(f"{root} holds no snapshot")
            version = found[1]
        self.version = version
        if self.meta().get("schema") != SCHEMA:
            raise ValueError(f"{root}: schema is not {SCHEMA}")

    def table(self, name: str, kinds: list[str] | None = None) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.root}/{self.version}/{name}")
        return frame.where(F.col("kind").isin(kinds)) if kinds else frame

    def meta(self) -> dict[str, str]:
        """The metadata, a few rows by construction."""
        facts = {r.key: r.value for r in self.spark.read.parquet(f"{self.root}/{self.version}/meta").collect()}
        added = f"{self.root}/{self.version}/meta_added"
        if exists(self.spark, added):
            rows = self.spark.read.parquet(added).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
            facts |= {r.key: r.value for r in rows.collect()}
        return facts

    def upsert_meta(self, **facts: str) -> None:
        """Add facts; of a key the latest stays. What a version was published with is not rewritten."""
        added = f"{self.root}/{self.version}/meta_added"
        seq = self.spark.read.parquet(added).agg(F.max("seq").alias("n")).first().n + 1 if exists(self.spark, added) else 1
        rows = [(k, v, seq) for k, v in sorted(facts.items())]
        self.spark.createDataFrame(rows, "key string, value string, seq int").coalesce(1).write.mode("append").parquet(added)

    def view(self, name: str) -> DataFrame:
        """A stored projection, refused unless it was made from this graph's digest."""
        if self.meta().get(f"view.{name}.digest") != self.meta().get("digest"):
            raise ValueError(f"view {name} was not made from this graph")
        return self.table(f"view_{name}")

    def store_view(self, name: str, frame: DataFrame, digest: str | None = None) -> None:
        frame.write.mode("overwrite").parquet(f"{self.root}/{self.version}/view_{name}")
        self.upsert_meta(**{f"view.{name}.digest": digest if digest is not None else self.meta().get("digest", "")})

    def upgrade(self, derived: dict[str, Callable[[Snapshot], DataFrame]]) -> list[str]:
        """Add the derived tables that this version lacks; the facts are not touched."""
        added = [n for n in derived if not exists(self.spark, f"{self.root}/{self.version}/{n}")]
        for name in added:
            derived[name](self).write.parquet(f"{self.root}/{self.version}/{name}")
        return added


_POOL: dict[tuple[str, str], Snapshot] = {}
POOL_SIZE = 4


def shared(spark: SparkSession, root: str) -> Snapshot:
    """The pooled handle of ``root``'s current version; the least recently used of more than four is dropped."""
    current = Snapshot(spark, root)
    key = (spark.sparkContext.applicationId, root)
    held = _POOL.pop(key, None)
    _POOL[key] = held if held is not None and held.version == current.version else current
    while len(_POOL) > POOL_SIZE:
        del _POOL[next(iter(_POOL))]
    return _POOL[key]


def products(spark: SparkSession, project: str) -> list[str]:
    """Folders below ``project`` that hold a snapshot, found by their current numbers."""
    fs, target = hadoop(spark, f"{project}/*/current")
    found = fs.globStatus(target)
    return sorted(str(s.getPath().getParent().getName()) for s in found)
