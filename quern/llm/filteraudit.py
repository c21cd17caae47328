"""Audit of how filters interact: what each removes in every order of applying them.

A row's failures are the bits of one mask. Conditions on a text alone are columns; that
a text repeats another row's is found by sorting: rows are dealt by ranges of (text
fingerprint, doc_id), each range is sorted by (fingerprint, text, doc_id), and a row is
compared with its predecessor. What a range cannot see is settled at its boundaries:
each range reports the texts of its last fingerprint with their first doc_id, a row or
so a range, and rows of a range's first fingerprint are held against these reports. A
group of copies of any size is so spread over ranges.

Masks are merged into counters that add up: rows by part, mask and labels, then by part,
filter and the set of filters before it. What a filter removes depends on that set
alone, so the orders only look up its counters.

Defined cases: a null text is an empty one. A null doc_id is larger than all others, and
neither repeats another row nor is repeated; rows that share doc_id and text do not
repeat each other. A null part is the empty string. Of several labels of a doc_id, a row
has each value that any of them has. An empty table gives no row. Extra columns are
ignored; ids may be of any type that orders; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.quality import words_of
from quern.llm.scratch import Scratch


@dataclass(frozen=True)
class Filter:
    """``fails`` maps a text and its words, neither null, to a condition."""

    letter: str
    fails: Callable[[Column, Column], Column]


#: The production filters; the duplicate filter follows them.
FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 100),
    Filter("B", lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
    Filter("C", lambda text, words: 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text)),
    Filter("D", lambda text, words: text.rlike("[#$%&*|]")),
)
DUPLICATES = "E"


def _compared(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the rows of a sorted range with their predecessors.

    Rows keep doc_id, part and mask and get ``again``: whether a smaller doc_id of the range
    has the text. Rows of the range's first fingerprint also get fp and the text's digest.
    Rows with a null mask are the range's report: fp, digest and first doc_id of each text
    under its last fingerprint (one, unless fingerprints collide).
    """

    def batch_of(doc_id, part, mask, again, fp, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, part, mask, again, fp, digest], ["doc_id", "part", "mask", "again", "fp", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None
        report: dict[bytes, object] = {}
        text_before = first_before = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, ids, fp = batch.column("text").cast(pa.large_string()), batch.column("doc_id"), batch.column("fp").to_numpy()
            starts = np.ones(n, dtype=bool)
            starts[1:] = ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
            carried = text_before is not None and text[0].as_py() == text_before
            starts[0] = not carried
            # Place of each row's group among its first ids; 0 is the group carried over.
            own = np.maximum.accumulate(np.where(starts, np.arange(1, n + 1), 0))
            firsts = pa.concat_arrays([pa.array([first_before if carried else None], kind), ids.cast(kind)]).take(pa.array(own))
            again = pc.fill_null(pc.greater(ids.cast(kind), firsts), False)
            if head is None:
                head = fp[0]
            digests: list[bytes | None] = [None] * n
            if fp[0] == head:
                digest = None
                for i in range(int(np.searchsorted(fp, head, side="right"))):
                    if digest is None or starts[i]:
                        digest = hashlib.sha256(text[i].as_py().encode("utf-8", "surrogatepass")).digest()
                    digests[i] = digest
            if fp[-1] != last:
                last, report = fp[-1], {}
            for i in np.flatnonzero(starts & (fp == last)):
                report[hashlib.sha256(text[i].as_py().encode("utf-8", "surrogatepass")).digest()] = ids[i].as_py()
            if not carried or starts.any():
                first_before = firsts[n - 1].as_py()
            text_before = text[n - 1].as_py()
            at_head = pa.array(fp, mask=fp != head)
            yield batch_of(ids.cast(kind), batch.column("part"), batch.column("mask"), again, at_head, pa.array(digests, pa.binary()))
        if report:
            k = len(report)
            nothing = [pa.nulls(k, t) for t in (pa.string(), pa.int32())]
            yield batch_of(pa.array(list(report.values()), kind), *nothing, pa.array([False] * k), pa.array([last] * k, pa.int64()), pa.array(list(report), pa.binary()))

    return run


def failures(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS, part: str = "lang") -> DataFrame:
    """doc_id, part and mask of every row; bit i is the i-th filter's, the one after them the duplicates'."""
    scratch = Scratch(docs.sparkSession, "filteraudit")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        # ``at`` only spreads rows that share doc_id and text.
        "*", F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("at")
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("at")]
    ranged = rows.repartitionByRange("fp", *order).sortWithinPartitions("fp", "text", *order)
    # The conditions come after the exchange, whose sampling would else compute them twice.
    worded = ranged.select("fp", "text", "doc_id", "part", words_of(F.col("text")).alias("words"))
    bits = [F.when(f.fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)]
    masked = worded.select("fp", "text", "doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("mask") if bits else F.lit(0).alias("mask"))
    kind = docs.schema["doc_id"].dataType
    narrow = masked.mapInArrow(_compared(_arrow(kind)), f"doc_id {kind.simpleString()}, part string, mask int, again boolean, fp long, digest binary")
    narrow = scratch.table(narrow, "compared")
    # A row or so for each range, whatever the table's size.
    edges = narrow.where("mask IS NULL AND doc_id IS NOT NULL").groupBy("fp", "digest").agg(F.min("doc_id").alias("first"))
    again = F.col("again") | F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    found = narrow.where("mask IS NOT NULL").join(F.broadcast(edges), ["fp", "digest"], "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << len(filters)).otherwise(0)).cast("int").alias("mask"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part, mask and labels: (part, mask, good, toxic, n)."""
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).where("good OR toxic")
    merged = failed.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = merged.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step."""
    k = len(letters)
    cases = [(before, i) for i in range(k) for before in range(1 << k) if not before & 1 << i]
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(i).alias("filter"), F.lit(1 << i).alias("bit")) for b, i in cases]))
    mask, before, bit = (F.col(c) for c in ("mask", "case.before", "case.bit"))
    earlier, fails = mask.bitwiseAND(before) != 0, mask.bitwiseAND(bit) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    sums = counted.select("*", case.alias("case")).groupBy("part", "case.before", "case.filter").agg(
        total(~earlier & ~fails)("kept"), total(~earlier & fails)("removed"), total(earlier & fails)("redundant"), total(mask == bit)("unique_fails"),
        total(~earlier & fails & F.col("good"))("good_lost"), total(~earlier & fails & F.col("toxic"))("toxic_lost"),
    )
    # In how many orders exactly the filters of ``before`` precede the filter.
    ways = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.bit_count("before") + 1)
    of_filter = Window.partitionBy("part", "filter")  # 2 ** (k - 1) rows
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * ways).over(of_filter))
    orders = []
    for order in permutations(range(k)):
        done = 0
        for step, i in enumerate(order, 1):
            orders.append(("".join(letters[j] for j in order), step, done, i))
            done |= 1 << i
    steps = counted.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sums.join(F.broadcast(steps), ["before", "filter"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in names))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, duplicates: str = DUPLICATES, part: str = "lang") -> DataFrame:
    """What every filter keeps and removes at each step of every order, by part."""
    letters = "".join(f.letter for f in filters) + duplicates
    return interactions(counters(failures(docs, filters, part), labels), letters)
