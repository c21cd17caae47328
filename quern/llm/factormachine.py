"""Quality classification by a factorisation machine.

A text's features are its words, hashed into ``DIM`` places with log(1 + count) scaled to
length 1, statistics of its structure, and its number of characters as the table gives
it. A statistic is one-hot over bins cut at quantiles of the learning sample. The score
is the logistic function of a bias, a weight per feature, and the dot product of two
features' factor vectors for every pair of features, summed in time linear in the number
of features: half the squared sum of a text's weighted factors less the sum of their
squares.

Learning: at most ``SAMPLE`` labelled ids, those with the least hash, are turned into
features once and stored. Every round is one pass of Spark tasks over the stored rows
with the current parameters; a task returns its summed gradient, and the driver takes an
Adam step. Scoring is one pass over all rows without a shuffle.

Defined cases: a null text is scored as an empty one, which has no words; a null, missing
or negative number of characters is counted from the text. Null ids and null labels are
not learned from; of several labels of an id the largest counts, of several rows of an id
the text with the least hash. Where nothing, or one label only, is learned from, every
score is the share of label 1 with one imagined label of each kind added. Repeated rows
score alike. Extra columns are ignored; ids may be of any type; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch
from quern.llm.words import Words, as_bytes, chunks, word_class

DIM = 1 << 12
FACTORS = 4
SAMPLE = 10_000
ROUNDS = 30
STEP = 0.05
RIDGE = 1e-3
THRESHOLD = 0.3
SLICES = 8
CHUNK = 1 << 18
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)

STATISTICS = ("words", "word_bytes", "capitals", "digits", "symbols", "marks", "distinct", "repeats", "lines", "equal_lines", "commonest", "chars")
_CAPITALS, _DIGITS, _SYMBOLS, _MARKS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"#*$%&|<>@^~_=+\\{}[]", b"!?.,;:"
BINS = len(QUANTILES) + 1
WIDTH = DIM + len(STATISTICS) * BINS


@dataclass
class Rows:
    """Sparse word features of several texts (row r holds places ptr[r] to ptr[r + 1]) and their statistics."""

    ptr: np.ndarray
    place: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def _statistics(raw: bytes, hashes: np.ndarray, word_bytes: int, chars: int) -> list[float]:
    n, size = len(hashes), max(1, len(raw))
    count = lambda of: len(raw) - len(raw.translate(None, of))
    lines = raw.split(b"\n")
    own, times = np.unique(hashes, return_counts=True)
    per_word = 1 / max(1, n)
    return [
        np.log1p(n), word_bytes * per_word, count(_CAPITALS) / size, count(_DIGITS) / size, count(_SYMBOLS) * per_word, count(_MARKS) * per_word,
        len(own) * per_word, int((hashes[1:] == hashes[:-1]).sum()) * per_word, len(lines) * per_word, 1 - len(set(lines)) / len(lines),
        int(times.max(initial=0)) * per_word, np.log1p(chars),
    ]


def extract(texts: list[str | None], chars: list[int | None]) -> Rows:
    """The features of a batch of texts."""
    raw = [as_bytes(t) for t in texts]
    ptr, places, values, stats = [np.zeros(1, dtype=np.int64)], [], [], []
    for first, last in chunks(raw, CHUNK):
        w = Words(raw[first:last], word_class())
        sizes = w.end - w.start
        owner = np.searchsorted(w.bounds[1:], np.arange(len(w.hashes)), side="right")
        cell, times = np.unique(owner * DIM + (w.hashes >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64), return_counts=True)
        row, value = cell // DIM, np.log1p(times)
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=last - first))
        ptr.append(ptr[-1][-1] + np.cumsum(np.bincount(row, minlength=last - first)))
        places.append(cell % DIM)
        values.append(value / norm[row])
        for i in range(first, last):
            a, b = w.bounds[i - first], w.bounds[i - first + 1]
            given = chars[i]
            stats.append(_statistics(raw[i], w.hashes[a:b], int(sizes[a:b].sum()), given if given is not None and given >= 0 else len(texts[i] or "")))
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return Rows(np.concatenate(ptr), joined(places, np.int32), joined(values, np.float32), np.array(stats, dtype=np.float64).reshape(-1, len(STATISTICS)))


def with_bins(rows: Rows, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, place, value) with a place for each statistic's bin after a row's words."""
    n, k = len(rows.ptr) - 1, len(STATISTICS)
    bins = np.stack([np.searchsorted(edges[j], rows.stats[:, j], side="right") + DIM + j * BINS for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    ptr = rows.ptr + k * np.arange(n + 1)
    place, value = np.empty(ptr[-1], dtype=np.int64), np.empty(ptr[-1], dtype=np.float64)
    word = np.ones(ptr[-1], dtype=bool)
    at = ptr[1:, None] - k + np.arange(k)[None]
    word[at.ravel()] = False
    place[word], value[word] = rows.place, rows.value
    place[at.ravel()], value[at.ravel()] = bins.ravel(), 1.0
    return ptr, place, value


@dataclass
class Machine:
    """``prior`` is the score where nothing could be learned; else ``bias``, ``weight`` and ``factor`` score."""

    edges: np.ndarray
    bias: float = 0.0
    weight: np.ndarray | None = None
    factor: np.ndarray | None = None
    prior: float = 0.5

    def raw(self, ptr: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, each row's summed factors, and each feature's weighted factors."""
        weighted = self.factor[place] * value[:, None]
        summed = np.add.reduceat(weighted, ptr[:-1])
        squares = np.add.reduceat(weighted * weighted, ptr[:-1])
        linear = np.add.reduceat(self.weight[place] * value, ptr[:-1])
        return self.bias + linear + 0.5 * (summed * summed - squares).sum(axis=1), summed, weighted

    def score(self, rows: Rows) -> np.ndarray:
        n = len(rows.ptr) - 1
        if self.weight is None or not n:
            return np.full(n, self.prior)
        return logistic(self.raw(*with_bins(rows, self.edges))[0])

    def gradient(self, rows: Rows, label: np.ndarray) -> np.ndarray:
        """The summed gradient of the log loss: bias, weights, then factors."""
        ptr, place, value = with_bins(rows, self.edges)
        z, summed, weighted = self.raw(ptr, place, value)
        off = logistic(z) - label
        per = np.repeat(off, np.diff(ptr)) * value
        # d score / d factor[i] = value[i] * (summed - weighted[i])
        inner = np.repeat(summed, np.diff(ptr), axis=0) - weighted
        columns = [np.bincount(place, weights=per, minlength=WIDTH)]
        columns += [np.bincount(place, weights=per * inner[:, f], minlength=WIDTH) for f in range(inner.shape[1])]
        return np.concatenate([[off.sum()], np.stack(columns, axis=1).ravel()])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, text, chars) of at most ``sample`` labelled ids."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = usable.orderBy(h, "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _chars(docs).alias("chars"))
    # At most ``sample`` ids are broadcast.
    picked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    row = F.struct("text", "chars")
    return picked.groupBy("doc_id", "label").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64("chars"))).alias("row")).select("label", "row.*")


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = extract(batch.column("text").to_pylist(), batch.column("chars").to_pylist())
            offsets = pa.array(x.ptr, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x.place, x.value)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists, *(pa.array(x.stats[:, j]) for j in range(x.stats.shape[1]))], ["label", "place", "value", *STATISTICS])

    return rows.mapInArrow(run, "label int, place array<int>, value array<float>, " + ", ".join(f"{s} double" for s in STATISTICS))


def _rows_of(batch: pa.RecordBatch) -> tuple[Rows, np.ndarray]:
    place, value = batch.column("place"), batch.column("value")
    ptr = np.concatenate(([0], np.cumsum(place.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    stats = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1)
    return Rows(ptr, place.flatten().to_numpy(), value.flatten().to_numpy(), stats), batch.column("label").to_numpy().astype(float)


def _gradient(stored: DataFrame, machine: Machine) -> np.ndarray:
    """The gradient over all stored rows; a task returns one row."""
    shared = stored.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                g = shared.value.gradient(*_rows_of(batch))
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["g"])

    parts = [np.frombuffer(bytes(r.g), np.float32).astype(float) for r in stored.mapInArrow(run, "g binary").collect()]  # one row a task, SLICES tasks or so
    shared.unpersist()
    return np.sum(sorted(parts, key=lambda p: p.tobytes()), axis=0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, factors: int = FACTORS) -> Machine:
    """Learn quality from the labelled rows of ``docs``."""
    stored = Scratch(docs.sparkSession, "factormachine").table(_featured(learning_rows(docs, labels, sample)).repartition(SLICES), "features")
    seen = stored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    n, ones = seen.n, seen.ones or 0
    prior = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return Machine(np.zeros((len(STATISTICS), len(QUANTILES))), prior=prior)
    edges = np.array(stored.approxQuantile(list(STATISTICS), list(QUANTILES), 0.002))
    rng = np.random.default_rng(7)
    point = np.concatenate([[np.log(prior / (1 - prior))], np.concatenate([np.zeros((WIDTH, 1)), rng.normal(0, 0.05, (WIDTH, factors))], axis=1).ravel()])
    speed, spread = np.zeros_like(point), np.zeros_like(point)

    def machine() -> Machine:
        table = point[1:].reshape(WIDTH, factors + 1)
        return Machine(edges, float(point[0]), np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1:]), prior)

    for t in range(1, rounds + 1):
        g = _gradient(stored, machine()) / n + RIDGE * point
        speed, spread = 0.9 * speed + 0.1 * g, 0.99 * spread + 0.01 * g * g
        point = point - STEP * (speed / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-6)
    return machine()


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = extract(batch.column("text").to_pylist(), batch.column("chars").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _chars(docs).alias("chars")).mapInArrow(run, f"doc_id {kind}, score double")


def cross_checked(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from four fifths of the ids, score all."""
    machine = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
