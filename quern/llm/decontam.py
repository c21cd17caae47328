"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are lower-cased (A-Z) and cut into words of ASCII letters and digits and of
all bytes beyond ASCII. Every run of ``width`` item words is a pattern (a shorter item
is one pattern); patterns are sequences of word numbers in one automaton, and a
document is scanned once as its own sequence of word numbers, where words that no item
has are number 0. Word numbers map to character offsets of the original text.

The automaton's items are broadcast, and it is built once per worker. Its size is
checked: items are packed into blocks of at most ``block_bytes`` of text. A benchmark of
one block is scanned for in one pass. A larger one takes a pass per block over what the
last pass stored, so there is one block in memory at a time, on the driver too, which
reads item texts through an iterator that holds one partition.

Defined cases: null and empty texts have no words and are clean; null and empty items
match nothing; repeated items count as one id each; a null item id is ignored.
Documents keep their rows, repeated ones too, and all their columns, whatever their
names. Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quern.llm.scratch import Scratch, free_names
from quern.llm.words import as_bytes

WIDTH = 13
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and turns every separator byte into a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(_FOLD).split()


class Scanner:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int = WIDTH):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item_id, words in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - width + 1)) if ids else ():
                windows.setdefault(tuple(ids[i : i + width]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in windows.items():
            self.automaton.add_word(key, (len(key), owners))
        self.empty, self.shortest = not windows, min(map(len, windows), default=1)
        self.known_run = re.compile(b"\x01{%d,}" % min(self.shortest, 60_000))
        if windows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the ids of the items that occur."""
        if self.empty or not words:
            return [], set()
        get, found, spans, seen = self.numbers.get, [], [], set()
        # A pattern has known words only, so only runs of them as long as a pattern are walked.
        known = bytes(map(self.numbers.__contains__, words))
        for run in self.known_run.finditer(known):
            first = run.start()
            ids = tuple([get(w, 0) for w in words[first : run.end()]])
            for end, (length, owners) in self.automaton.iter(ids):
                found.append((first + end + 1 - length, first + end + 1))
                seen |= owners
        for start, end in sorted(found):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        return spans, seen


def word_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges in ``text`` of spans of word numbers."""
    raw = as_bytes(text)
    folded = raw.translate(_FOLD)
    starts, ends, at = [], [], 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    chars = lambda i: len(raw[:i].decode("utf-8", "surrogatepass"))
    return [(chars(starts[a]), chars(ends[b - 1])) for a, b in spans]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Distinct items in blocks of bounded size, in the order of their ids."""
    block, size = [], 0
    rows = items.select("item_id", "text").where(F.col("item_id").isNotNull()).distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        words = item_words(row.text)
        if words:
            if block and size + len(row.text) > block_bytes:
                yield block
                block, size = [], 0
            block.append((row.item_id, words))
            size += len(row.text)
    yield block


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Found]:
    """Per document: n_words, merged spans of hit words, ids of items found.

    Returns the columns of ``docs`` followed by three, and the names of those.
    """
    spark, scratch = docs.sparkSession, None
    found = Found(*free_names(docs, "n_words", "spans", "items"))
    out, last, shared = docs, None, None
    for block in item_blocks(items, block_bytes):
        if shared is not None:
            scratch = scratch or Scratch(spark, "decontam")
            stored = scratch.table(out, "scanned")
            if last is not None:
                scratch.drop(last)
            shared.unpersist()
            out = last = stored
        first, shared = shared is None, spark.sparkContext.broadcast(block)
        out = _scan_block(out, shared, width, found, first)
    return out, found


class Found(NamedTuple):
    """Names of the columns that a scan adds."""

    n_words: str
    spans: str
    items: str

    def n_hit(self) -> Column:
        return F.aggregate(F.col(self.spans), F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, block, width: int) -> Scanner:
    """One automaton per worker process, kept from task to task."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(block.value, width)
    return _SCANNERS[key]


def _scan_block(docs: DataFrame, block, width: int, found: Found, first: bool) -> DataFrame:
    names = [n for n in docs.columns if n not in found]
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, block, width)
        for batch in batches:
            old = None if first else (batch.column(found.spans), batch.column(found.items))
            n_words, spans, ids = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = item_words(text.as_py())
                hit, seen = scanner.scan(words)
                seen = {str(x) for x in seen}
                if old is not None:
                    hit = _merge([(x["a"], x["b"]) for x in old[0][i].as_py()] + hit)
                    seen |= set(old[1][i].as_py())
                n_words.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in hit])
                ids.append(sorted(seen))
            cols = [batch.column(n) for n in names] + [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*names, *found])

    schema = StructType([docs.schema[n] for n in names]).add(found.n_words, LongType())
    schema = schema.add(found.spans, ArrayType(StructType().add("a", IntegerType()).add("b", IntegerType()))).add(found.items, ArrayType(StringType()))
    return docs.mapInArrow(run, schema)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is part of a test window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    out, found = scan(docs.select("doc_id", "text"), items)
    return out.select("doc_id", F.col(found.n_words).alias("n_words"), found.n_hit().alias("n_hit"), F.col(found.items).alias("items")).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with their columns as they were."""
    out, found = scan(docs, items)
    return out.where(~contaminated(found.n_hit(), F.col(found.n_words))).select(*(f"`{n}`" for n in docs.columns))


def located(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item ids and the character spans of hits in the original text."""
    out, found = scan(docs.select("doc_id", "text"), items)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            spans = [[{"start": a, "end": b} for a, b in word_offsets(r["text"], [(x["a"], x["b"]) for x in r[found.spans]])] for r in rows]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(found.items), pa.array(spans, kind)], ["doc_id", "items", "spans"])

    hit = out.where(F.size(found.spans) > 0)
    return hit.mapInArrow(offsets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, items array<string>, spans array<struct<start:int,end:int>>")


def items_digest(ids: list[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
