"""Language identification by nearest centroid.

A text's vector holds its byte trigrams, hashed into ``DIM`` places, as log(1 + count)
times the inverse document frequency, scaled to length 1. Each language has several
centroids, found by spherical k-means over a sample of its training texts (at most
``SAMPLE`` a language, those with the smallest hash of their id; document frequencies
come from all training texts). At most ``LANGS`` languages are learned, those with the
most training texts, so the model has a fixed bound. A text gets the language of the centroid with the
highest cosine. A text farther from it than all but a hundredth of that language's
sample is marked as rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is
everything if nothing was learned. Null languages are not learned from. Repeated rows
are treated alike; of rows that share an id and a language, the one whose text has the
least hash is learned from. Extra columns are ignored; texts of any length are read
whole; ids may be of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import as_bytes, chunks

DIM = 1 << 13
SAMPLE = 500
LANGS = 512
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.01
UNDETERMINED = "und"
CHUNK = 1 << 18

#: Lower-cases A-Z, keeps bytes beyond ASCII, and makes all else a space.
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], dtype=np.uint32)
_LETTER = re.compile(r"[^\W\d_]")


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of hashed trigram counts per text."""
    sizes = np.array([len(t) + 2 for t in texts])
    buf = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    gram = (buf[:-2] << np.uint32(16) | buf[1:-1] << np.uint32(8) | buf[2:]) * np.uint32(2654435761)
    place = (gram >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    cell = (owner[:-2] * DIM + place)[inside]
    return np.bincount(cell, minlength=len(texts) * DIM).reshape(len(texts), DIM)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(rows.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-12)[:, None]


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1; the first is the mean, the next ones the farthest rows."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    centres = unit(v.mean(axis=0))[None]
    while len(centres) < min(k, len(v)):
        centres = np.vstack([centres, v[np.argmin((v @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = np.argmax(v @ centres.T, axis=1)
        centres = np.vstack([unit(v[own == j].sum(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        raw = [as_bytes(texts[i]) for i in at]
        for first, last in chunks(raw, CHUNK):
            for a in range(first, last, 64):
                b = min(a + 64, last)
                cosine = vectors(counts(raw[a:b]), self.idf) @ self.centres.T
                best = np.argmax(cosine, axis=1)
                for i, j, row in zip(at[a:b], best, cosine, strict=True):
                    lang = self.owner[j]
                    langs[i], scores[i] = self.langs[lang], float(min(1.0, max(0.0, row[j])))
                    rejected[i] = bool(row[j] < self.least[lang])
        return langs, scores, rejected


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts, and number of texts that have a trigram of each place.

    A task adds up its own texts; the tasks' sums are added by place before they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            raw = [as_bytes(t.as_py()) for t in batch.column("text")]
            n += len(raw)
            for first, last in chunks(raw, CHUNK):
                for a in range(first, last, 64):
                    total += (counts(raw[a : min(a + 64, last)]) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.concatenate(([n], total)), pa.int64())], ["place", "n"])

    summed = training.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = np.zeros(DIM + 1, dtype=np.int64)
    for r in summed.collect():  # DIM + 1 rows, whatever the table's size
        found[r.place + 1] = r.n
    return found[1:], int(found[0])


def _sampled(training: DataFrame, sample: int, langs: int) -> DataFrame:
    """(lang, h, text): ``sample`` texts of each language, those with the least hash of the id.

    A language of any size is thinned before it is ranked: three times as many ids as wanted
    are expected under its threshold, so no task ranks more than that many rows.
    """
    hashed = training.withColumn("h", F.xxhash64("doc_id"))
    sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("n")).orderBy(F.desc("rows"), "lang").limit(langs)
    under = F.shiftrightunsigned("h", 1) / float(1 << 63) < F.lit(3.0 * sample) / F.col("n")
    keys = hashed.select("lang", "h").join(F.broadcast(sizes), "lang").where((F.col("n") <= 3 * sample) | under).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = keys.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")
    # At most langs * sample rows of 20 bytes or so.
    picked = hashed.select("lang", "h", "text").join(F.broadcast(chosen), ["lang", "h"])
    return picked.groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(training: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, langs: int = LANGS) -> Model:
    """Learn from the columns doc_id, text and lang of ``training``."""
    training = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    df, n = _frequencies(training)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        raw = [as_bytes(t) for t in rows["text"]]
        v = np.vstack([vectors(counts([t]), idf) for t in raw])
        own = spherical_kmeans(v, k)
        least = float(np.quantile((v @ own.T).max(axis=1), REJECT_SHARE))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centres": [own.tobytes()], "least": [least]})

    learned = _sampled(training, sample, langs).groupBy("lang").applyInPandas(learn, "lang string, centres binary, least double")
    found = sorted(learned.collect(), key=lambda r: r.lang)  # at most ``langs`` rows
    centres = [np.frombuffer(bytes(r.centres), np.float32).reshape(-1, DIM) for r in found]
    owner = [i for i, own in enumerate(centres) for _ in own]
    whole = np.vstack(centres) if centres else np.zeros((0, DIM), np.float32)
    return Model(idf, [r.lang for r in found], whole, np.array(owner, dtype=int), np.array([r.least for r in found]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def cross_checked(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the ids, predict all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
