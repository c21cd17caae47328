"""Compression of vectors to codes: product quantisation over distinct integer parts.

Components become integers and a vector is cut into consecutive parts. Equal parts of a
position are merged into one row with its weight, counted before the shuffle. Weighted
Lloyd rounds read these distinct rows: a task assigns its rows to their nearest entries
and adds up weights and weighted components by entry, so a round returns one number per
entry and component, whatever the table's size. At the end codes and errors of the
distinct parts are joined back to the vectors. All sums are integers, so results do not
depend on how rows are dealt.

Joins back meet keys that hold a large share of all rows. Rows heavier than a thousandth
of the table are at most a thousand a position; they are broadcast, and only the others
are shuffled by key.

Defined cases: vectors that are null, empty or hold a null or non-finite component are
dropped, as are vectors whose length is not the table's commonest (ties to the longer).
Where the length is no multiple of the number of parts, part p holds the components from
p * length // parts on. Components are held within 2**25 after scaling, so that sums stay
exact. Rows that share an id count each by itself; a codebook starts from distinct ids,
with the least of an id's vectors, null ids last. With fewer ids than entries the codebook
has an entry per id. Null labels are one label. An empty table gives no row. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 25
#: Share of all rows from which a key counts as heavy; there are at most so many heavy keys.
HEAVY = 1000


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` with whole finite ``vector`` only, and its floored components as ``ints``."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    scaled = lambda v: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), v.cast("double") * scale))
    return vectors.where(x.isNotNull() & (F.size(x) > 0)).where(finite).withColumn("ints", F.transform(x, lambda v: F.floor(scaled(v)).cast("int")))


def bounds(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry and its squared distance, both exact.

    Products go through floating point where all sums stay below 2**52.
    """
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, rows.shape[1]) < 1 << 52 else np.int64
    x, c = rows.astype(kind), book.astype(kind)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
    own = np.argmin(d, axis=1)
    return own, d[np.arange(len(d)), own].astype(np.int64)


def _by_position(batch: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their components) for each position in the batch."""
    position, lists = batch.column("pos").to_numpy(), batch.column("part")
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        yield int(p), at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), widths[p]).astype(np.int64)


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one weighted round over (pos, part, n)."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)
    widths = [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in shared.value]
        for batch in batches:
            weight = batch.column("n").to_numpy()
            for p, at, rows in _by_position(batch, widths):
                own, _ = nearest(rows, shared.value[p])
                n = weight[at]
                np.add.at(sums[p], own, np.column_stack([n, rows * n[:, None]]))
        for p, s in enumerate(sums):
            entry, col = np.nonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(entry), pa.int32()), pa.array(entry, pa.int32()), pa.array(col, pa.int32()), pa.array(s[entry, col])], ["pos", "entry", "col", "s"])

    summed = distinct.mapInArrow(run, "pos int, entry int, col int, s long").groupBy("pos", "entry", "col").agg(F.sum("s").alias("s"))
    totals = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
    for r in summed.collect():  # at most one row per codebook component and entry
        totals[r.pos][r.entry, r.col] = r.s
    return [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(totals, books, strict=True)]


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``distinct`` with the code and error of each part."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)
    widths = [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for p, at, rows in _by_position(batch, widths):
                code[at], error[at] = nearest(rows, shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "n", "code", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part array<int>, n long, code int, error long")


def join_weighted(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, total: int, bring: list[str]) -> DataFrame:
    """``rows`` with the columns ``bring`` of ``unique``, which has every key once and its weight in ``rows``.

    Keys may be null. Heavy keys are broadcast (at most HEAVY of ``total`` rows' worth), so
    no shuffled key holds more than a thousandth of the rows.
    """
    heavy = F.col(weight) * HEAVY >= total
    renamed = unique.select(*(F.col(k).alias(f"_{k}") for k in keys), *bring, heavy.alias("_heavy"))
    same = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    first = rows.join(F.broadcast(renamed.where("_heavy")), same, "left")
    hot = first.where("_heavy").select(*rows.columns, *bring)
    cold = first.where("_heavy IS NULL").select(*rows.columns)
    same = [cold[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    return hot.unionByName(cold.join(renamed.where("NOT _heavy"), same).select(*rows.columns, *bring))


@dataclass
class Codes:
    """``rows`` has vec_id, label, code (hex digits), error and label_error of every kept row."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel()).encode()).hexdigest()


def first_books(stored: DataFrame, edges: list[int], entries: int) -> list[np.ndarray]:
    """Per position, that part of the vectors with the smallest ids."""
    ids = stored.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).withColumnRenamed("vec_id", "_id")
    least = stored.join(F.broadcast(ids), stored["vec_id"].eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("ints").alias("ints"))
    rows = least.orderBy(F.col("vec_id").asc_nulls_last()).collect()  # at most ``entries``
    whole = np.array([r.ints for r in rows], dtype=np.int64)
    return [whole[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> Codes:
    """Codes of the columns vec_id, ``vector`` and label."""
    scratch = Scratch(vectors.sparkSession, "veccodes")
    kept = integers(vectors, vector, scale).select("vec_id", "label", "ints", F.monotonically_increasing_id().alias("rid"))
    kept = scratch.table(kept, "kept")
    lengths = kept.groupBy(F.size("ints").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    length, total = (lengths.d, lengths.n) if lengths else (0, 0)
    kept = kept.where(F.size("ints") == length)
    edges = bounds(length, parts)
    books = first_books(kept, edges, entries) if lengths else [np.zeros((0, 0), np.int64)] * parts
    cut = F.array(*[F.slice("ints", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)])
    pieces = kept.select("rid", F.posexplode(cut).alias("pos", "part"))
    distinct = scratch.table(pieces.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")), "distinct")
    for _ in range(rounds if lengths else 0):
        books = lloyd_round(distinct, books)
    coded = scratch.table(assigned(distinct, books), "coded")
    joined = join_weighted(pieces, coded, ["pos", "part"], "n", total, ["code", "error"])
    digits = F.lpad(F.lower(F.hex("code")), max(2, len(f"{entries - 1:x}")), "0")
    by_row = joined.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", digits.alias("code")))).alias("codes"), F.sum("error").alias("error"))
    written = by_row.select("rid", F.array_join(F.transform("codes", lambda c: c["code"]), "").alias("code"), "error")
    rows = scratch.table(kept.select("rid", "vec_id", "label").join(written, "rid").drop("rid"), "rows")
    by_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error"))
    return Codes(join_weighted(rows, by_label, ["label"], "n", total, ["label_error"]), books)


def digest(vectors: DataFrame) -> DataFrame:
    codes = encode(vectors)
    return codes.rows.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
