"""Suffix-array dedup with a run-length index.

Removes every byte covered by a string of ``WINDOW`` bytes that also starts anywhere
else, in another document or in the same one.

Candidates come from ``anchors``. The contexts that share an anchor are indexed together:
a Burrows-Wheeler transform of the contexts, each closed by a symbol of its own, is
compressed to runs, and suffix-array samples are kept at the run ends. The longest
match of a position is one less than that of the position before it unless the two
suffixes' transform symbols differ, that is, unless it stands at a run's end. So only
run ends are compared with their neighbours across the end, and the matching statistics
of all other positions stream from these samples, one pass from left to right. Positions
whose statistic is at least ``WINDOW`` mark their match. In a repetitive block the runs
are long and the comparisons few.

Defined cases: null and empty texts have no bytes; a text shorter than a window loses
nothing; repeated rows are places of their own, so a repeated long text is removed
whole; a null ``doc_id`` is a document like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import anchors
from quern.llm.anchors import Windows, merged
from quern.llm.scratch import Scratch
from quern.llm.words import as_bytes

WINDOW = 200
#: Anchors of 40 bytes: long enough not to repeat by chance, short enough to be few.
KIND = Windows(WINDOW, 40, by_word=False)
BLOCK_BYTES = 2 << 20
_FIRST = 3


class RunIndex:
    """A run-compressed transform of several byte strings with samples at run ends."""

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.n = int(sizes.sum())
        text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + m
        text[self.starts + sizes - 1] = np.arange(m)
        self.text = text
        self._sort(text, m + 256)
        before = text[self.order - 1]
        ends = np.flatnonzero(before[1:] != before[:-1])
        #: The transform's runs: symbols and lengths, and the suffixes at the end of each and the start of the next.
        self.run_symbols = before[np.concatenate(([0], ends + 1))]
        self.run_lengths = np.diff(np.concatenate(([0], ends + 1, [self.n])))
        self.run_last, self.run_next = self.order[ends], self.order[ends + 1]
        del self.order

    def _sort(self, text: np.ndarray, letters: int) -> None:
        """Suffix order by prefix doubling; keeps the ranks of each length for common prefixes."""
        n = self.n
        padded = np.concatenate((text + 1, np.zeros(_FIRST, dtype=np.int64)))
        key = np.zeros(n, dtype=np.int64)
        for k in range(_FIRST):
            key = key * (letters + 1) + padded[k : k + n]
        self.levels: list[tuple[int, np.ndarray]] = []
        length = _FIRST
        while True:
            self.order = np.argsort(key)
            new = key[self.order]
            rank = np.empty(n, dtype=np.int32)
            rank[self.order] = np.cumsum(np.concatenate(([0], new[1:] != new[:-1])), dtype=np.int32)
            self.levels.append((length, rank))
            if rank[self.order[-1]] == n - 1:
                return
            behind = np.zeros(n, dtype=np.int64)
            behind[: n - length] = rank[length:].astype(np.int64) + 1
            key = rank.astype(np.int64) * (n + 1) + behind
            length *= 2

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.zeros(len(a), dtype=np.int64)
        for length, rank in reversed(self.levels):
            x, y = a + size, b + size
            inside = np.maximum(x, y) < self.n
            same = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            size += same * length
        for _ in range(_FIRST - 1):  # the ranks' lengths are multiples of the first
            x, y = a + size, b + size
            inside = np.maximum(x, y) < self.n
            size += inside & (self.text[np.minimum(x, self.n - 1)] == self.text[np.minimum(y, self.n - 1)])
        return size

    def matching_statistics(self) -> np.ndarray:
        """Of each position, the length of its longest match that starts at any other."""
        size = self.common_prefix(self.run_last, self.run_next)
        reach = np.arange(self.n)
        for side in (self.run_last, self.run_next):
            np.maximum.at(reach, side, side + size)
        # From one position to the next a match loses its first byte; closing symbols end it with its string.
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def long_matches(self, least: int) -> list[list[tuple[int, int]]]:
        """For each string, the ranges covered by matches of at least ``least`` bytes."""
        size = self.matching_statistics()
        long = np.flatnonzero(size >= least)
        depth = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(depth, long, 1)
        np.add.at(depth, long + size[long], -1)
        inside = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for owner, x, y in zip((np.searchsorted(self.starts, a, side="right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
            base = int(self.starts[owner])
            out[owner].append((x - base, y - base))
        return out


def match_block(rows: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """Byte spans with a match elsewhere in the block, of contexts that have one place."""
    found = RunIndex([r["body"] for r in rows]).long_matches(WINDOW)
    for r, spans in zip(rows, found, strict=True):
        if r["places"] == 1:
            for a, b in spans:
                yield r["did"], r["sub"], r["at"] + a, r["at"] + b


def repeated_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, sub, a, b): byte ranges covered by strings that start elsewhere too."""
    shared = anchors.shared_anchors(rows, KIND, scratch)
    compared = anchors.owned_contexts(shared, scratch).where("fewest = 1")
    several = shared.groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("h", "c")
    whole = shared.join(several, ["h", "c"]).select("did", "sub", F.col("at").alias("a"), (F.col("at") + F.col("n") + WINDOW - 1).alias("b"))
    spans = whole
    for bodies, cut in anchors.narrowed(anchors.bodies(rows, compared, KIND, scratch), KIND, scratch):
        spans = spans.unionByName(anchors.indexed(bodies, match_block, BLOCK_BYTES))
        if cut is not None:
            often = cut.groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "c", "n")
            spans = spans.unionByName(cut.join(often, ["h", "c", "n"]).select("did", "sub", F.col("at").alias("a"), (F.col("at") + F.col("n") + WINDOW - 1).alias("b")))
    return scratch.table(spans, "spans")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the kept bytes and their kept_sha256."""
    scratch = Scratch(docs.sparkSession, "runindex")
    rows = anchors.keyed(docs)
    touched, clean = anchors.with_spans(rows, repeated_spans(rows, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            n, removed, runs, kept = [], [], [], []
            for text, found in zip(batch.column("text"), spans, strict=True):
                raw, out, at = as_bytes(text.as_py()), [], 0
                joined = merged(found)
                for a, b in joined:
                    out.append(raw[at:a])
                    at = b
                out.append(raw[at:])
                n.append(len(raw))
                removed.append(sum(b - a for a, b in joined))
                runs.append(len(joined))
                kept.append(b"".join(out))
            cols = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return touched.select("doc_id", "text", "spans").mapInArrow(run, schema).unionByName(clean.select("doc_id", "text").mapInArrow(run, schema))


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
