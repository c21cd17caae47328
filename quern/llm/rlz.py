"""Substring dedup by relative Lempel-Ziv parsing.

Removes every word covered by a window of ``WINDOW`` words whose word sequence also
starts earlier (a smaller ``doc_id``, or the same document further left).

Candidates come from ``anchors``: places of a context other than its first one are
duplicates as a whole. First places are parsed: the contexts that share an anchor form
a reference block, in corpus order, and each is factored greedily against the contexts
before it. A factor of at least a window's length is a duplicate span. The windows that
cross a factor's end are looked up one by one before the parse goes on, so a window
that occurs earlier is found even if no single factor holds it.

Defined cases: null and empty texts, and texts of fewer words than a window, lose
nothing. A null ``doc_id`` comes first. Rows with the same ``doc_id`` and text have the
same places and keep or lose the same words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import anchors
from quern.llm.anchors import Windows, merged
from quern.llm.scratch import Scratch
from quern.llm.words import Words, as_bytes, ngram_hashes, word_class

WINDOW = 20
KIND = Windows(WINDOW, 3, by_word=True)
BLOCK_BYTES = 1 << 20


def parse(context: list[int], reference: dict[int, tuple[int, int]], earlier: list[list[int]]) -> list[tuple[int, int]]:
    """Factor one context's windows against the reference, then add the new ones to it.

    ``reference`` maps a window to its first place (context, offset) in ``earlier``,
    whose last entry is this context. Returns ranges of duplicate windows.
    """
    factors, i = [], 0
    while i < len(context):
        source = reference.get(context[i])
        if source is None:
            reference[context[i]] = (len(earlier) - 1, i)
            i += 1
            continue
        row, at = earlier[source[0]], source[1]
        length = 1
        while i + length < len(context) and at + length < len(row) and row[at + length] == context[i + length]:
            length += 1
        factors.append((i, i + length))
        i += length
    return factors


def parse_block(rows: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """Duplicate word spans of the contexts of several anchors, each in corpus order.

    A repeated row brings its contexts once more at the same places, next to each other
    in the order; one of them is parsed, as a place is no copy of itself.
    """
    rows = [r for i, r in enumerate(rows) if not i or _place(r) != _place(rows[i - 1])]
    words = Words([r["body"] for r in rows], word_class())
    grams = ngram_hashes(words.hashes, WINDOW).tolist()
    at = 0
    for _, group in groupby(rows, key=lambda r: r["h"]):
        reference: dict[int, tuple[int, int]] = {}
        earlier: list[list[int]] = []
        for r in group:
            first = int(words.bounds[at])
            context = grams[first : first + r["n"]]
            earlier.append(context)
            for a, b in parse(context, reference, earlier):
                yield r["did"], r["sub"], r["at"] + a, r["at"] + b + WINDOW - 1
            at += 1


def _place(row: dict) -> tuple[int, int, int, int]:
    return row["h"], row["did"], row["sub"], row["at"]


def duplicate_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, sub, a, b): word ranges of every document that are found earlier."""
    shared = anchors.shared_anchors(rows, KIND, scratch)
    compared = anchors.owned_contexts(shared, scratch)
    first = shared.groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("did", "sub", "at")).alias("o")).where("places > 1")
    again = (
        shared.join(first.select("h", "c", "o"), ["h", "c"])
        .where((F.col("did") != F.col("o.did")) | (F.col("sub") != F.col("o.sub")) | (F.col("at") != F.col("o.at")))
        .select("did", "sub", F.col("at").alias("a"), (F.col("at") + F.col("n") + WINDOW - 1).alias("b"))
    )
    spans = again
    for bodies, cut in anchors.narrowed(anchors.bodies(rows, compared, KIND, scratch), KIND, scratch):
        spans = spans.unionByName(anchors.indexed(bodies, parse_block, BLOCK_BYTES))
        if cut is not None:
            least = cut.groupBy("h", "c", "n").agg(F.min(F.struct("did", "sub", "at")).alias("o"), F.count(F.lit(1)).alias("k")).where("k > 1")
            later = cut.join(least.select("h", "c", "n", "o"), ["h", "c", "n"]).where(F.struct("did", "sub", "at") != F.col("o"))
            spans = spans.unionByName(later.select("did", "sub", F.col("at").alias("a"), (F.col("at") + F.col("n") + WINDOW - 1).alias("b")))
    return scratch.table(spans, "spans")


def _words_left(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = raw.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept text (words joined by one space), kept_sha256."""
    scratch = Scratch(docs.sparkSession, "rlz")
    rows = anchors.keyed(docs)
    touched, clean = anchors.with_spans(rows, duplicate_spans(rows, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            made = [_words_left(as_bytes(t.as_py()), merged(s)) for t, s in zip(batch.column("text"), spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                 pa.array([m[2].decode("utf-8", "surrogatepass") for m in made], pa.string()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string())],
                ["doc_id", "n_words", "n_removed", "text", "kept_sha256"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string, kept_sha256 string"
    return touched.select("doc_id", "text", "spans").mapInArrow(run, schema).unionByName(clean.select("doc_id", "text").mapInArrow(run, schema))


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("text")
