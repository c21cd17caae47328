"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table ``(k1, k2, doc)``: the 128-bit hashes of the lines that a batch
of documents brought, each with a document that holds it, bucketed by all three and
sorted in each bucket. A new batch is reduced to its different triples, merge-anti-joined
with every run, and what no run holds yet is a run of its own. Runs have one layout, so
the anti-joins shuffle the batch once and the runs never. When a level has ``fanout``
runs they are merged into one run of the next level, bucket by bucket.

Runs hold no triple twice, so a line's number of triples in all runs is its number of
documents, whatever the batches were. Lines found in at least ``min_docs`` documents are
dropped from every document but the largest ``doc_id`` that holds them. A line that a
third of all documents hold is that many triples in as many buckets, and its count is
added up before the shuffle. The main path is built from DataFrame functions alone.

Defined cases: a null or empty text is one empty line. A null ``doc_id`` counts as
smaller than any other; ids are whole numbers (text that is none is an error). Rows with
the same ``doc_id`` count as one document, whatever their texts and batches; with the same
text they lose the same lines. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

WHITE = " \t\n\x0b\f\r"
NO_ID = -(1 << 63)
N_BATCHES = 5


def fold_ascii(x: Column) -> Column:
    """A string that is equal for two inputs exactly if they agree up to the case of A-Z.

    ``lower`` alone would also fold other letters, and ``translate`` costs ten times as
    much. Text beyond ASCII is lower-cased as Latin-1 over its UTF-8 bytes: this folds
    A-Z and maps some lead bytes of two-byte characters onto lead bytes of longer ones,
    which the number of continuation bytes after them still tells apart.
    """
    as_latin = F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.lower(as_latin))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_keys(text: Column, min_chars: int) -> Column:
    """Line numbers and hashes of the lines of ``min_chars`` code points less the white ends."""
    numbered = F.transform(_lines(text), lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(WHITE)).alias("line")))
    long = F.filter(numbered, lambda x: F.char_length(x["line"]) >= min_chars)
    return F.transform(long, lambda x: F.struct(x["at"].alias("at"), _hashes(fold_ascii(x["line"])).alias("h")))


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


KEYS = ("k1", "k2", "doc")


class LineRuns:
    """The levelled store of line hashes."""

    SCHEMA = "k1 long, k2 long, doc long"

    def __init__(self, spark: SparkSession, fanout: int = 3, min_chars: int = 40, buckets: int | None = None):
        self.scratch = Scratch(spark, "line-runs")
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        """Store ``rows``, which come dealt by the keys, as a bucketed, sorted run."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.select(*KEYS).write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).format("parquet")
        writer.option("compression", "zstd").option("path", self.scratch.path(f"level{level}")).saveAsTable(name)
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return union_all([self.spark.table(n) for n in names])

    def _drop(self, name: str) -> None:
        where = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.delete(where)

    def postings(self, docs: DataFrame) -> DataFrame:
        """One row per long line of a batch."""
        rows = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("hash"), F.explode(_long_keys(F.col("text"), self.min_chars)).alias("x"))
        return rows.select("doc", "hash", F.col("x.at").alias("at"), F.col("x.h.k1").alias("k1"), F.col("x.h.k2").alias("k2"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The triples that no run holds yet: a merge anti-join with each run's buckets."""
        for name in self.runs():
            keys = keys.join(self.spark.table(name).hint("merge"), list(KEYS), "left_anti")
        return keys

    def add(self, postings: DataFrame) -> None:
        """Add a batch of postings: its different triples less the known ones are a new run."""
        keys = postings.select(*KEYS).repartition(self.buckets, *KEYS).distinct()
        self._write(self.fresh(keys), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full).repartition(self.buckets, *KEYS), level + 1)
            for name in full:
                self._drop(name)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Lines of at least ``min_docs`` documents, with the largest one."""
        counted = self._read(self.runs()).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))
        return counted.where(F.col("n_docs") >= min_docs).select("k1", "k2", "max_doc")

    def close(self) -> None:
        """Drop the runs; nothing that reads them may be left to run."""
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = 5, min_chars: int = 40, n_batches: int = N_BATCHES) -> DataFrame:
    """One row per document with its text less the dropped lines.

    ``batches`` are the parts of ``docs`` as they arrived. If not given, the rows are
    dealt into ``n_batches`` by a hash of id and text, whatever the table's files; the
    table is read and its lines are hashed once. Returns doc_id, text, n_lines and
    n_dropped; the batches change neither.
    """
    runs = LineRuns(docs.sparkSession, min_chars=min_chars)
    if batches is None:
        batch = F.pmod(F.xxhash64("hash", "doc"), F.lit(n_batches)).cast("int")
        stored = runs.scratch.table(runs.postings(docs).withColumn("batch", batch), "postings", by="batch")
        parts = [stored.where(F.col("batch") == k) for k in range(n_batches)]
    else:
        parts = [runs.scratch.table(runs.postings(part), "postings") for part in batches]
        stored = union_all(parts)
    for part in parts:
        runs.add(part)
    frequent = runs.scratch.table(runs.frequent(min_docs), "frequent")
    runs.close()
    named = docs.select("doc_id", "text", _doc().alias("_doc"), F.xxhash64("text").alias("_hash"))
    hits = stored.join(frequent, ["k1", "k2"]).where(F.col("doc") != F.col("max_doc"))
    drops = hits.groupBy(F.col("doc").alias("_doc"), F.col("hash").alias("_hash")).agg(F.collect_set("at").alias("drop"))
    lines = _lines(F.col("text"))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(lines, i)), "\n")
    return named.join(drops, ["_doc", "_hash"], "left").select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
