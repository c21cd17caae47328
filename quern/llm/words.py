"""Word and shingle hashing over batches of texts, vectorised with numpy.

A batch of texts becomes one byte buffer. Words are maximal runs of bytes that a
256-entry class table accepts, so a scan needs no regular expression and no Python
loop per word. A word's hash is a polynomial over a fixed random byte table, taken
from one prefix sum, modulo 2**64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64

#: Bytes that end a word: space and \t \n \v \f \r.
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _CHUNK * 2)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            row = np.full(size, base, dtype=U64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; entry i covers the first i symbols."""
    up, _ = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_byte_values()[buf] * up, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal content wherever it stands."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def chunks(texts: list[bytes], limit: int = _CHUNK):
    """Cut a list into runs (first, last) of about ``limit`` bytes; a text stays whole."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of several texts: byte spans, hashes, and each text's word range."""

    __slots__ = ("bounds", "buf", "end", "hashes", "offsets", "start")

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        inside = is_word[self.buf]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        sums = prefix_sums(self.buf)
        self.hashes = range_hash(sums, self.start, self.end) + (self.end - self.start).astype(U64)
        self.bounds = np.searchsorted(self.start, self.offsets)


@lru_cache(maxsize=4)
def word_class(separators: bytes = WHITE) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    if len(hashes) < n:
        return np.empty(0, dtype=U64)
    total = np.zeros(len(hashes) - n + 1, dtype=U64)
    for k in range(n):
        total = total * U64(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - n + 1 + k]
    return mix(total)


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
