"""Finding repeated windows: anchors, contexts and where they stand.

A window is ``window`` consecutive symbols (bytes or words) of one document. Its anchor
is the run of ``gram`` symbols in it with the least hash, leftmost if tied, so equal
windows have equal anchors at equal places. Consecutive windows mostly share an anchor;
together they form a context, the text from the first one's start to the last one's
end. A repeated window therefore lies in contexts with the same anchor hash, and

* anchors whose hash is found once in the corpus are dropped (a count that is combined
  before the shuffle, and a join that can be split where a passage is very frequent),
* equal contexts are collapsed to the first of them, its owner, with their number,
* the owners' contexts alone are compared, grouped by anchor hash, by an index that each
  operator supplies.

An anchor with more than ``MOST_CONTEXTS`` different contexts (the edge of a passage that
very many documents share) is not gathered. Its windows are told apart by their offset,
the distance from a window's start to the anchor. All windows whose offset is in the upper
half of the range hold a longer common stretch around the anchor, and so do those of the
lower half; each context is cut into these two, with the longer stretch's hash as anchor.
Equal windows have equal offsets, so they meet again. Halves are collapsed and compared
like contexts, and cut again where too many are left. At the edge of a passage, one half
mostly becomes equal in all documents or different in all, and is settled; after
log2(window) cuts an anchor is a whole window and all its contexts are equal. So the work
is linear in the number of contexts, and a group of any size is split.

Rows are told apart by ``did`` (the id, null as the smallest) and ``sub``, 0 unless the
table repeats ids; then it is a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch
from quern.llm.words import U64, Words, _powers, as_bytes, chunks, mix, word_class

NO_ID = -(1 << 63)
MOST_CONTEXTS = 256
FILTER_BITS = 1 << 23
_PLACE_BITS = U64(34)


@dataclass(frozen=True)
class Windows:
    """What a window is: its length, the anchor's length, and whether symbols are words."""

    window: int
    gram: int
    by_word: bool


def symbols(texts: list[bytes], kind: Windows) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """Symbol values of several texts on end, and where each text's symbols begin."""
    if kind.by_word:
        words = Words(texts, word_class())
        return words.hashes, words.bounds, words
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    table = mix(np.arange(1, 257, dtype=U64))
    return table[buf], np.concatenate(([0], np.cumsum([len(t) for t in texts]))), None


def _least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash in each run of ``width`` grams, the leftmost of equals."""
    n = len(grams)
    keyed = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=U64)
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, dtype=U64)
    padded[:n] = keyed
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(after[:m], before[width - 1 : width - 1 + m])
    return (least & ((U64(1) << _PLACE_BITS) - U64(1))).astype(np.int64)


def contexts(values: np.ndarray, bounds: np.ndarray, kind: Windows) -> tuple[np.ndarray, ...]:
    """Per context: text number, first window's start in it, number of windows, anchor and context hash."""
    empty = np.empty(0, dtype=np.int64)
    if len(values) < kind.window:
        return empty, empty, empty, empty, empty
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    grams = mix((sums[kind.gram :] - sums[: -kind.gram]) * down[: len(values) + 1 - kind.gram])
    place = _least_places(grams, kind.window - kind.gram + 1)
    doc = np.searchsorted(bounds, np.arange(len(place)), side="right") - 1
    valid = np.flatnonzero(np.arange(len(place)) + kind.window <= bounds[doc + 1])
    if not len(valid):
        return empty, empty, empty, empty, empty
    at = place[valid]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))))
    start, n = valid[first], np.diff(np.concatenate((first, [len(valid)])))
    end = start + n + kind.window - 1
    whole = mix((sums[end] - sums[start]) * down[start] + n.astype(U64))
    owner = doc[start]
    return owner, start - bounds[owner], n, mix(grams[at[first]]).view(np.int64), whole.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """did, sub, doc_id and text of every row."""
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    sub = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeats else F.lit(0)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), sub.alias("sub"), "doc_id", "text")


def anchor_rows(rows: DataFrame, kind: Windows) -> DataFrame:
    """(h, c, did, sub, at, n) of every context of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [as_bytes(t.as_py()) for t in batch.column("text")]
            did, sub = batch.column("did").to_numpy(zero_copy_only=False), batch.column("sub").to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                values, bounds, _ = symbols(texts[a:b], kind)
                owner, at, n, h, c = contexts(values, bounds, kind)
                cols = [h, c, did[a:b][owner], sub[a:b][owner].astype(np.int32), at.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "did", "sub", "at", "n"])

    return rows.select("did", "sub", "text").mapInArrow(run, "h long, c long, did long, sub int, at int, n int")


def possible(rows: DataFrame, ids: DataFrame) -> Column | tuple[DataFrame, str]:
    """``rows`` with a column ``_maybe``: false only if (did, sub) is not in ``ids``.

    A filter of ``FILTER_BITS`` bits, whatever the number of ids, so its broadcast has a
    fixed bound (131,072 words). It saves shuffling texts that nothing is known of; as it
    fills up, more texts take the join, which alone decides.
    """
    bit = F.pmod(F.xxhash64("did", "sub"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits"))
    tagged = rows.withColumn("_bit", bit)
    tagged = tagged.join(F.broadcast(words), F.shiftright("_bit", 6) == words["_word"], "left")
    return tagged.withColumn("_maybe", F.coalesce(F.expr("(shiftright(_bits, cast(_bit & 63 as int)) & 1L) = 1L"), F.lit(False))).drop("_bit", "_word", "_bits")


def shared_anchors(rows: DataFrame, kind: Windows, scratch: Scratch) -> DataFrame:
    """The contexts whose anchor hash is found at least twice."""
    found = scratch.table(anchor_rows(rows, kind), "anchors")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    shared = scratch.table(found.join(often, "h"), "shared-anchors")
    scratch.drop(found)
    return shared


def owned_contexts(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per different context: its first place, its number of places, and of its anchor
    the number of contexts and whether any of them is found once."""
    per = shared.groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("did", "sub", "at")).alias("o"))
    per = scratch.table(per.select("h", "c", "n", "places", "o.did", "o.sub", "o.at"), "contexts")
    by_anchor = per.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.min("places").alias("fewest")).where("different > 1")
    return scratch.table(per.join(by_anchor, "h"), "compared")


_BODY = "h long, c long, n int, places long, different long, fewest long, did long, sub int, at int, body binary"
_CUT = f"{_BODY}, anchor int, low int, high int"
_ARROW = {"h": pa.int64(), "c": pa.int64(), "n": pa.int32(), "places": pa.int64(), "different": pa.int64(), "fewest": pa.int64(), "did": pa.int64(), "sub": pa.int32(), "at": pa.int32(), "body": pa.binary(), "anchor": pa.int32(), "low": pa.int32(), "high": pa.int32()}


def bodies(rows: DataFrame, wanted: DataFrame, kind: Windows, scratch: Scratch) -> DataFrame:
    """The wanted contexts with their texts; those of a repeated row come once for each."""
    listed = wanted.select("did", "sub", F.struct("h", "c", "n", "places", "different", "fewest", "at").alias("x")).groupBy("did", "sub").agg(F.collect_list("x").alias("list"))
    near = possible(rows.select("did", "sub", "text"), wanted).where("_maybe").drop("_maybe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in list(_ARROW)[:10]}
            for did, sub, text, items in zip(*(batch.column(k) for k in ("did", "sub", "text", "list")), strict=True):
                raw = as_bytes(text.as_py())
                words = Words([raw], word_class()) if kind.by_word else None
                for x in items.as_py():
                    a, end = x["at"], x["at"] + x["n"] + kind.window - 1
                    body = raw[words.start[a] : words.end[end - 1]] if words else raw[a:end]
                    _put(out, *(x[k] for k in ("h", "c", "n", "places", "different", "fewest")), did.as_py(), sub.as_py(), a, body)
            yield _batch(out)

    return scratch.table(near.join(listed, ["did", "sub"]).mapInArrow(run, _BODY), "bodies")


def _put(out: dict[str, list], *row: object) -> None:
    for column, value in zip(out.values(), row, strict=True):
        column.append(value)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for k, v in out.items()], list(out))


def halves(hot: DataFrame, kind: Windows, first: bool) -> DataFrame:
    """Each context cut into its windows of the upper and of the lower offsets.

    ``anchor`` is the anchor's place in the body; a context holds windows with offsets
    from ``low`` to ``high`` - 1 only (the anchor place less the window's start).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _ARROW}
            for r in batch.to_pylist():
                values, _, words = symbols([r["body"]], kind)
                up, down = _powers(len(values) + 1)
                sums = np.zeros(len(values) + 1, dtype=U64)
                np.cumsum(values * up[:-1], out=sums[1:])
                if first:
                    grams = mix((sums[kind.gram :] - sums[: -kind.gram]) * down[: len(values) + 1 - kind.gram])
                    anchor, low, high = int(np.flatnonzero(mix(grams).view(np.int64) == r["h"])[0]), 0, kind.window - kind.gram + 1
                else:
                    anchor, low, high = r["anchor"], r["low"], r["high"]
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle, high)):
                    # Windows start from anchor - hi + 1 to anchor - lo, and the body has those from 0 to n - 1.
                    a, b = max(0, anchor - hi + 1), min(r["n"], anchor - lo + 1)
                    if a >= b or lo >= hi:
                        continue
                    stretch = (anchor - lo, anchor - hi + 1 + kind.window)
                    whole = (a, b + kind.window - 1)
                    h, c = (int(mix((sums[y : y + 1] - sums[x : x + 1]) * down[x : x + 1] + U64(salt)).view(np.int64)[0]) for (x, y), salt in ((stretch, (lo << 32) + hi), (whole, ((anchor - a) << 32) + b - a)))
                    body = r["body"][words.start[whole[0]] : words.end[whole[1] - 1]] if words else r["body"][whole[0] : whole[1]]
                    _put(out, h, c, b - a, r["places"], None, None, r["did"], r["sub"], r["at"] + a, body, anchor - a, lo, hi)
            yield _batch(out)

    return hot.mapInArrow(run, _CUT)


def narrowed(found: DataFrame, kind: Windows, scratch: Scratch) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Bodies to compare, level by level, and the rows whose halves may be equal to others.

    Yields first the bodies of anchors with at most ``MOST_CONTEXTS`` contexts and None,
    then for each cut of the rest the same of the halves, and all these halves.
    """
    cool = F.col("different") <= MOST_CONTEXTS
    yield found.where(cool), None
    hot, level = found.where(~cool), 0
    while not hot.isEmpty():
        cut = scratch.table(halves(hot, kind, level == 0), f"halves{level}")
        place = F.struct("did", "sub", "at")
        whole = cut.groupBy("h", "c", "n").agg(
            F.sum("places").alias("places"), F.min(place).alias("o"), *(F.min_by(x, place).alias(x) for x in ("body", "anchor", "low", "high"))
        )
        whole = scratch.table(whole.select("h", "c", "n", "places", "o.did", "o.sub", "o.at", "body", "anchor", "low", "high"), f"contexts{level}")
        by_anchor = whole.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.min("places").alias("fewest")).where("different > 1")
        kept = scratch.table(whole.join(by_anchor, "h"), f"compared{level}")
        yield kept.where(cool), cut
        hot, level = kept.where(~cool), level + 1


Index = Callable[[list[dict]], Iterator[tuple[int, int, int, int]]]


def indexed(found: DataFrame, index: Index, block_bytes: int) -> DataFrame:
    """Spans (did, sub, a, b) that ``index`` finds in blocks of whole anchor groups.

    Groups are sorted together; a block closes at the first group end beyond
    ``block_bytes``, and a group is bounded by ``MOST_CONTEXTS`` contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size > block_bytes and row["h"] != block[-1]["h"]:
                    yield spans(block)
                    block, size = [], 0
                block.append(row)
                size += len(row["body"])
        if block:
            yield spans(block)

    def spans(block: list[dict]) -> pa.RecordBatch:
        found = list(index(block))
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["did", "sub", "a", "b"])

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = found.select("h", "n", "places", "did", "sub", "at", "body").repartition(n, "h").sortWithinPartitions("h", "did", "sub", "at")
    return grouped.mapInArrow(run, "did long, sub int, a int, b int")


def with_spans(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their list of spans, and the rows that surely have none."""
    lists = spans.groupBy("did", "sub").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    tagged = possible(rows, spans)
    with_list = tagged.where("_maybe").drop("_maybe").join(lists, ["did", "sub"], "left")
    return with_list, tagged.where("NOT _maybe").drop("_maybe")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
