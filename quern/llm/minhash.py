"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set is its distinct five-word shingles; its signature has ``COORDINATES``
minima. Equal sets are one class, represented by its smallest ``doc_id``. Class
representatives are posted under each (coordinate, value) pair. Two sets with
similarity s agree in a binomial number of coordinates, and a pair is kept only if at
least ``MATCHES`` agree, which a pair at 0.75 misses with a probability below 1e-8.

* Prefix: postings are ordered by how many documents share them, rarest first. A pair
  with ``MATCHES`` agreements meets in the first ``COORDINATES - MATCHES + 1`` of them,
  so the commonest values, such as those of a passage that many documents hold, are
  never joined. Values of one document alone cannot collide and are not joined either.
* Collisions are counted where postings are joined, before any shuffle of pairs. A pair
  whose joined postings alone reach ``MATCHES`` is retained as it is.
* Skip: the postings left out are merged only for pairs that met and are still short of
  ``MATCHES``, by comparing the two signatures.
* Groups of near copies: first each posting list is joined with one hub of its own (a
  linear number of pairs), and links are confirmed on the full sets. Only lists that
  still hold more than one component are looked at again, for pairs in different
  components; a pair inside a component can't change the result, so nothing is lost.
* Dense groups: documents of open lists longer than ``LONG_LIST`` may be thousands of
  variants of one text that hardly differ in similarity. Their pairs never become rows.
  They are posted under the first ``DENSE_COORDINATES`` coordinates (a pair at 0.75
  agrees in none of them with a probability below 1e-8), each list is dealt into
  sub-blocks of bounded size, and a task takes two sub-blocks, counts all their common
  shingles as a matrix product, and returns a spanning forest of the links it finds.

Defined cases: words are runs of bytes other than space and \\t-\\r with A-Z
lower-cased; a text of fewer than five words has its whole sequence as its one shingle;
null texts and texts without words have no set, link with nothing, and are their own
component. Rows are nodes of their own, also those that share a ``doc_id``: each of its
texts has its own links, and ``component_id`` is the smallest id that its text reaches. A
null ``doc_id`` is never linked. Extra columns are ignored by ``components`` and kept by
``keep_one``, of which rows with the same id and text are one document. Ids may be of any
type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.scratch import Scratch, free_names
from quern.llm.words import U64, Words, as_bytes, chunks, mix, ngram_hashes, word_class

WIDTH = 5
COORDINATES = 48
MATCHES = 18
LONG_LIST = 64
DENSE_COORDINATES = 14
SUB_BLOCK = 1024
SUB_BLOCK_BYTES = 8 << 20
SIMILAR = (3, 4)

_ODD = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1, COORDINATES + 1, dtype=U64) + U64(1 << 40))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (already lower-cased)."""
    words = Words(texts, word_class())
    grams = ngram_hashes(words.hashes, width)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(ngram_hashes(words.hashes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.empty(0, dtype=U64))
    return out


def sign(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets, one row each."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rows = np.empty((COORDINATES, len(sets)), dtype=np.uint32)
    for i in range(COORDINATES):
        rows[i] = np.minimum.reduceat(((joined * _ODD[i] + _ADD[i]) >> U64(32)).astype(np.uint32), starts)
    return rows.T


def _fold(text: str | None) -> bytes:
    return as_bytes(text).lower()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, a 128-bit fingerprint of the set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_fold(t.as_py()) for t in batch.column("text")]
            n, lo, hi, sig = [], [], [], []
            for first, last in chunks(texts, 1 << 19):
                sets = shingle_sets(texts[first:last])
                n += [len(s) for s in sets]
                lo += [int(mix(s).sum(dtype=U64)) for s in sets]
                hi += [int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)) for s in sets]
                full = [s for s in sets if len(s)]
                signed = iter(sign(full).view(np.int32) if full else ())
                sig += [next(signed) if len(s) else None for s in sets]
            as_long = lambda x: pa.array(np.array(x, dtype=U64).view(np.int64))
            cols = [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), as_long(lo), as_long(hi), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_shingles", "lo", "hi", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, lo long, hi long, sig array<int>")


def similar(common: int, a: int, b: int) -> bool:
    """At least three quarters of the union are common."""
    return SIMILAR[1] * common >= SIMILAR[0] * (a + b - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; ``texts`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}

        def set_of(side: str, node: object, text: pa.Scalar) -> np.ndarray:
            if last[side][0] != node:
                last[side] = (node, shingle_sets([_fold(text.as_py())])[0])
            return last[side][1]

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            linked = []
            for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                one, two = set_of("a", x, s), set_of("b", y, t)
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(similar(common, len(one), len(two)))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _prefix_postings(reps: DataFrame) -> DataFrame:
    """(key, id, n) of the rarest postings of each representative that are shared at all."""
    value = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = reps.select("id", "n", F.posexplode("sig").alias("at", "v")).select("id", "n", value.alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_id = Window.partitionBy("id")
    ranked = (
        posted.join(shared, "key")
        .withColumn("rank", F.row_number().over(by_id.orderBy("df", "key")))
        .withColumn("n_shared", F.count(F.lit(1)).over(by_id))
    )
    in_prefix = COORDINATES - F.col("n_shared") + F.col("rank") <= COORDINATES - MATCHES + 1
    return ranked.where((F.col("n_shared") >= MATCHES) & in_prefix).select("key", "id", "n")


def _sizes_allow(a: str, b: str):
    return (SIMILAR[1] * F.col(a) >= SIMILAR[0] * F.col(b)) & (SIMILAR[1] * F.col(b) >= SIMILAR[0] * F.col(a))


def _skip_merged(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that agree in enough coordinates: by their counted collisions, or with the skipped ones."""
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    short = pairs.where(F.col("collisions") < MATCHES).join(left, "a").join(right, "b").where(same >= MATCHES)
    return pairs.where(F.col("collisions") >= MATCHES).select("a", "b").unionByName(short.select("a", "b"))


SET = ["lo", "hi", "n_shingles"]


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, and of the row's component the least (doc_id, th), null without a set."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.table(signatures(docs), "signatures")
    sets = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.table(sets.groupBy(*SET).agg(F.min(F.struct("doc_id", "th")).alias("rep")), "classes")
    # A class is named by its least id, unless some id has several sets.
    shared = not classes.groupBy("rep.doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    classes = classes.withColumn("id", F.xxhash64(*SET) if shared else F.col("rep.doc_id"))
    found = linked_components(docs, sets, classes, scratch)
    linked = classes.join(found, "id")
    least = linked.groupBy("component").agg(F.min("rep").alias("root"))
    roots = scratch.table(linked.join(least, "component").select(*SET, "root"), "roots")
    of_class = classes.join(roots, SET, "left").select(*SET, F.coalesce("root", "rep").alias("root"))
    # A row without an id or words meets no class.
    keys = [F.when(F.col("doc_id").isNotNull(), F.col(k)).alias(k) if k == "lo" else F.col(k) for k in SET]
    return signed.select("doc_id", "th", F.col("n_shingles").alias("n"), *keys).join(of_class, SET, "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "root")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    return _labelled(docs).select("doc_id", "n_shingles", F.coalesce("root.doc_id", "doc_id").alias("component_id"))


def linked_components(docs: DataFrame, sets: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for the classes that have a link; a class has lo, hi, n_shingles, id and rep."""
    named = classes.select(*SET, "id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    reps = sets.join(named, ["doc_id", "th", *SET]).select("id", "doc_id", "th", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["id"])
    reps = scratch.table(reps, "reps")
    posted = scratch.table(_prefix_postings(reps), "postings")
    ids = posted.select("id").distinct()
    wanted = reps.select("id", "doc_id", "th").join(ids, "id", "left_semi")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(wanted, ["doc_id", "th"]).select("id", "text")
    texts = scratch.table(texts, "texts")
    reps = reps.join(ids, "id", "left_semi")

    hub = posted.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"))
    pairs = posted.join(hub, "key").select(F.col("hub.id").alias("a"), F.col("hub.n").alias("m"), F.col("id").alias("b"), "n")
    pairs = scratch.table(_counted(pairs.where((F.col("a") != F.col("b")) & _sizes_allow("n", "m"))), "hub-pairs")
    links = scratch.table(confirmed(_skip_merged(pairs, reps), texts), "hub-links")
    found = scratch.table(connected_components(links, scratch), "components")

    moved = posted.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    state = moved.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y")
    lists = scratch.table(moved.join(state.select("key", "size"), "key"), "open-lists")
    dense = scratch.table(lists.where(F.col("size") > LONG_LIST).select("id", "comp").distinct(), "dense")
    tagged = lists.where(F.col("size") <= LONG_LIST).join(dense.select("id", F.lit(True).alias("dense")), "id", "left").drop("size")
    tagged = tagged.withColumn("dense", F.coalesce("dense", F.lit(False)))
    other = tagged.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), F.col("dense").alias("dense_b"))
    apart = (F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & ~(F.col("dense") & F.col("dense_b")) & _sizes_allow("n", "m")
    more = _counted(tagged.withColumnRenamed("id", "a").join(other, "key").where(apart)).join(pairs, ["a", "b"], "left_anti")
    more = scratch.table(_skip_merged(more, reps), "list-pairs")
    new = scratch.table(confirmed(more, texts).unionByName(_dense_links(dense, reps, texts, scratch)), "list-links")
    if new.isEmpty():
        return found
    return scratch.table(connected_components(links.unionByName(new), scratch), "components")


def _counted(pairs: DataFrame) -> DataFrame:
    """Each pair that collides, with its collisions, which are added up before the shuffle."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("collisions"))


def _packed(texts: DataFrame) -> DataFrame:
    """id and the sorted shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_fold(t.as_py()) for t in batch.column("text")]
            bodies: list[bytes] = []
            for first, last in chunks(raw, 1 << 19):
                bodies += [s.tobytes() for s in shingle_sets(raw[first:last])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary())], ["id", "body"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, body binary")


def common_counts(one: list[np.ndarray], two: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each set of one list with each of the other."""
    sides = [np.concatenate([*x, np.empty(0, dtype=U64)]) for x in (one, two)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    total = np.zeros((len(one), len(two)), dtype=np.float32)
    if not len(shared):
        return total
    places = []
    for sets, joined in zip((one, two), sides, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(shared, joined), len(shared) - 1)
        inside = shared[column] == joined
        order = np.argsort(column[inside], kind="stable")
        places.append((row[inside][order], column[inside][order]))
    for first in range(0, len(shared), width):
        parts = []
        for sets, (row, column) in zip((one, two), places, strict=True):
            a, b = np.searchsorted(column, [first, first + width])
            part = np.zeros((len(sets), width), dtype=np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest that connects what the symmetric matrix connects."""
    waiting, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not waiting[start]:
            continue
        waiting[start] = False
        frontier = np.array([start])
        while len(frontier):
            met = linked[frontier] & waiting
            next_ = np.flatnonzero(met.any(axis=0))
            out += [(int(frontier[met[:, j].argmax()]), int(j)) for j in next_]
            waiting[next_] = False
            frontier = next_
    return out


def _dense_links(dense: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between different components among documents of long open lists."""
    bodies = scratch.table(_packed(texts.join(dense.select("id"), "id", "left_semi")).dropDuplicates(["id"]), "packed")
    coordinates = F.slice("sig", 1, DENSE_COORDINATES)
    posted = reps.join(dense, "id").dropDuplicates(["id"]).select("id", "comp", F.posexplode(coordinates).alias("at", "v"))
    sized = posted.join(bodies.select("id", F.octet_length("body").alias("bytes")), "id")
    lists = sized.groupBy("at", "v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes")).where("x <> y")
    parts = F.greatest(F.ceil(F.col("size") / SUB_BLOCK), F.ceil(F.col("bytes") / SUB_BLOCK_BYTES)).cast("int").alias("parts")
    dealt = posted.join(lists.select("at", "v", parts), ["at", "v"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("at", "v", F.least("sub", "t").alias("i"), F.greatest("sub", "t").alias("j"), "sub", "id", "comp").join(bodies, "id")

    def evaluate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        rows = rows.sort_values("id", kind="stable")
        one = rows[rows["sub"] == key[2]]
        two = rows[rows["sub"] == key[3]]
        if rows["comp"].nunique() < 2 or not len(one) or not len(two):
            return empty
        sets = [[np.frombuffer(b, dtype=U64) for b in side["body"]] for side in (one, two)]
        common = common_counts(*sets)
        n = [np.array([len(s) for s in side], dtype=np.float32) for side in sets]
        linked = SIMILAR[1] * common >= SIMILAR[0] * (n[0][:, None] + n[1][None, :] - common)
        linked &= one["comp"].to_numpy()[:, None] != two["comp"].to_numpy()[None, :]
        ids = one["id"].to_numpy()
        if key[2] != key[3]:
            ids = np.concatenate((ids, two["id"].to_numpy()))
            whole = np.zeros((len(ids), len(ids)), dtype=bool)
            whole[: len(one), len(one) :] = linked
            linked = whole | whole.T
        found = spanning_links(linked)
        return pd.DataFrame({"a": ids[[x for x, _ in found]], "b": ids[[y for _, y in found]]}) if found else empty

    kind = dense.schema["id"].dataType.simpleString()
    found = dealt.groupBy("at", "v", "i", "j").applyInPandas(evaluate, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def digest(docs: DataFrame) -> DataFrame:
    return components(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns as they were; rows without a set stay.

    It is the row with the least (doc_id, hash of the text).
    """
    found = _labelled(docs)
    kept = found.where(F.col("doc_id").isNotNull() & (F.col("root").isNull() | (F.col("root") == F.struct("doc_id", "th"))))
    key, hash_ = free_names(docs, "key", "hash")
    kept = kept.select(F.col("doc_id").alias(key), F.col("th").alias(hash_)).distinct()
    named = docs.withColumn(key, F.col("doc_id")).withColumn(hash_, F.xxhash64("text"))
    chosen = named.join(kept, [key, hash_], "left_semi").dropDuplicates([key, hash_]).drop(key, hash_)
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))
