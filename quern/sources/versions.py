"""Tables whose versions share the files that did not change, and a cache of scanned contents.

``Versions``: rows are dealt into buckets by their key. A version is a manifest that names
the folder of every bucket; a change set reads and writes the buckets of its keys alone,
and the next manifest names the new folders of these and the old ones of all others.

``ScanCache``: facts by content digest and scanner version. It outlives the session; only
contents that it lacks are scanned.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import numbered

BUCKETS = 64
#: Folders of a cache that are merged into one when there are more.
RUNS = 16


class Versions:
    """The table under ``root``, one row per value of ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _bucket(self) -> Column:
        return (F.crc32(F.col(self.key).cast("string")) % self.buckets).cast("int")

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """(number, {schema, buckets, batches}); number 0 before the first version."""
        if number is not None:
            return number, json.loads(numbered.read(self.spark, f"{self.root}/versions", number))
        found = numbered.last(self.spark, f"{self.root}/versions")
        return (found[0], json.loads(found[1])) if found else (0, {"schema": None, "buckets": {}, "batches": {}})

    def _folders(self, buckets: dict[str, str]) -> list[str]:
        return [f"{self.root}/data/{folder}/_bucket={b}" for b, folder in sorted(buckets.items())]

    def read(self, number: int | None = None) -> DataFrame:
        """A version's rows, the current one's if none is named."""
        found, state = self.manifest(number)
        if not found:
            raise FileNotFoundError(f"{self.root} has no version")
        return self._rows(state, state["buckets"])

    def _rows(self, state: dict, buckets: dict[str, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], state["schema"])
        return self.spark.read.schema(state["schema"]).parquet(*self._folders(buckets))

    def apply(self, fresh: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, attempts: int = 5) -> list[int]:
        """Put ``fresh`` rows in place of those with their keys and drop the keys ``gone``; the buckets written.

        ``batch`` is a stream's name and number: a batch that the current version holds
        already changes nothing. A writer that is overtaken tries again on the version
        that overtook it.
        """
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema)
        keys = fresh.select(self.key)
        keys = keys.unionByName(gone.select(self.key)) if gone is not None else keys
        touched = sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        for attempt in range(attempts):
            number, state = self.manifest()
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return []
            own = {b: f for b, f in state["buckets"].items() if int(b) in touched}
            rows = fresh
            if own:
                rows = self._rows(state, own).join(keys.distinct(), self.key, "left_anti").select(fresh.columns).unionByName(fresh)
            folder = uuid.uuid4().hex
            dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket").sortWithinPartitions("_bucket", self.key)
            dealt.write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
            fs, target = numbered.hadoop(self.spark, f"{self.root}/data/{folder}")
            written = [x.getPath().getName().split("=")[1] for x in fs.listStatus(target) if "=" in x.getPath().getName()]
            kept = {b: f for b, f in state["buckets"].items() if int(b) not in touched}
            batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
            text = json.dumps({"schema": schema, "buckets": kept | dict.fromkeys(written, folder), "batches": batches})
            try:
                numbered.append(self.spark, f"{self.root}/versions", text, above=number)
                return touched
            except numbered.Overtaken:
                if attempt == attempts - 1:
                    raise
        return []


class ScanCache:
    """Facts of contents, kept under ``root`` for one ``version`` of the scanner."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.root = spark, f"{root}/{version}"

    def _state(self) -> tuple[int, list[str], str | None]:
        found = numbered.last(self.spark, f"{self.root}/runs")
        state = json.loads(found[1]) if found else {"folders": [], "schema": None}
        return (found[0] if found else 0), state["folders"], state["schema"]

    def _held(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def scan(self, files: DataFrame, scanner: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """(``files`` with their ``facts``, how many contents were scanned).

        ``files`` has (path, sha, text); ``scanner`` maps (sha, text) to (sha, facts), facts
        being one value, null where there are none. A content is scanned once, whatever
        number of files has it. A null digest is never kept.
        """
        number, folders, schema = self._state()
        missing = files.where("sha IS NOT NULL")
        if folders:
            missing = missing.join(self._held(folders, schema).select("sha"), "sha", "left_anti")
        once = missing.groupBy("sha").agg(F.min("text").alias("text"))
        found = once.select("sha").join(scanner(once), "sha", "left")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        folder = uuid.uuid4().hex
        found.write.parquet(f"{self.root}/data/{folder}")
        scanned = self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}").count()
        if scanned:
            folders = [*folders, folder]
            numbered.append(self.spark, f"{self.root}/runs", json.dumps({"folders": folders, "schema": schema}), above=number)
            if len(folders) > RUNS:
                self.keep(None)
                folders = self._state()[1]
        facts = self._held(folders, schema) if folders else found
        return files.join(facts.dropDuplicates(["sha"]), "sha", "left").select("path", "sha", "facts"), scanned

    def keep(self, referenced: DataFrame | None) -> None:
        """Merge the runs into one, without contents that ``referenced`` (column sha) does not name."""
        number, folders, schema = self._state()
        if not folders:
            return
        rows = self._held(folders, schema).dropDuplicates(["sha"])
        if referenced is not None:
            rows = rows.join(referenced.select("sha").distinct(), "sha", "left_semi")
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{folder}")
        numbered.append(self.spark, f"{self.root}/runs", json.dumps({"folders": [folder], "schema": schema}), above=number)
