"""Token counts by the rules of the vocabulary at hand, without building the pieces.

The kind of a model file decides: scores of a BPE model are merge ranks, those of a
unigram model log-probabilities, and neither means anything under the other's rules.

BPE: of all neighbouring symbols (characters at first) whose join is a piece, the pair
of the highest score, leftmost if tied, is joined until none is left. A character that
is no piece counts its bytes with byte fallback; without, neighbouring ones are one
unknown. These are the rules of the public ``sentencepiece`` library.

Unigram: a count-only Viterbi. An Aho-Corasick automaton enumerates every vocabulary piece that ends at a position;
dynamic programming keeps the best score and its piece count, never the pieces. The tie
and unknown rules are those of the public ``tokenizers`` library's Unigram model: a
later candidate replaces an earlier one only if its score is strictly higher, and
candidates come by start, so of equal scores the longest last piece stays; a character
that no single-character piece covers may be an unknown, worth the lowest score less
10; neighbouring unknowns are one piece, or with byte fallback one piece a byte. White
space is the Metaspace form: a leading mark, and a mark for each space.

A piece never has the mark after another character, nor a line end inside, in most
vocabularies. Where the vocabulary at hand has that property a text is cut into words,
exactly, and word counts are kept in a bounded table per worker. Where it has not, the
whole text is one run through the same program.

Defined cases: null and empty texts have no tokens. Repeated rows are counted alike and
other columns are ignored. A word of any length takes time and memory in proportion.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
TABLE_ENTRIES = 1_000_000
KEEP_CHARS = 64


class Vocabulary:
    """Pieces with their scores; small and of fixed size, so it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.pieces, self.byte_fallback = pieces, byte_fallback
        names = {p for p, _ in pieces}
        self.all_bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # Fused unknowns could span a cut, unless each of their bytes counts or the cut is at a known piece.
        cuts_known = self.all_bytes or {MARK, "\n"} <= names
        self.separable = cuts_known and _within_words(names)

    def counter(self) -> Counter:
        return Counter(self)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """Read the pieces of a model file; control and unknown pieces never match text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in ids], any(model.is_byte(i) for i in ids))


    def without_dominated(self) -> Vocabulary:
        """Leave out pieces which no best segmentation has.

        Where other pieces make up a piece's text at a strictly higher total (by more
        than rounding), replacing it always helps, so it is never chosen and never tied.
        Of ranked merges used as a unigram model, most long pieces are of this kind.
        """
        automaton = _automaton(self.pieces)
        kept = []
        for piece, own in self.pieces:
            best = [0.0] + [-inf] * len(piece)
            for end, (length, s) in automaton.iter(piece):
                if length < len(piece):
                    best[end + 1] = max(best[end + 1], best[end + 1 - length] + s)
            if not best[-1] > own + 1e-6 * max(1.0, abs(own)):
                kept.append((piece, own))
        slim = Vocabulary(kept, self.byte_fallback)
        slim.unknown_score, slim.all_bytes = self.unknown_score, self.all_bytes
        return slim


class Merges:
    """Pieces of a BPE model with their merge ranks; small and of fixed size, so it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float]], all_bytes: bool):
        self.ranks, self.all_bytes = dict(pieces), all_bytes
        self.separable = (all_bytes or {MARK, "\n"} <= self.ranks.keys()) and _within_words(self.ranks.keys())

    def counter(self) -> MergeCounter:
        return MergeCounter(self)


def load(path: str) -> Vocabulary | Merges:
    """The vocabulary of a model file, of the kind that the file says it is."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, form, piece = model.trainer_spec, model.normalizer_spec, model.SentencePiece
    if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix or not form.escape_whitespaces or kind.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: texts are normalised in a way that is not built")
    if kind.model_type == kind.UNIGRAM:
        return Vocabulary.from_sentencepiece(path)
    if kind.model_type != kind.BPE or any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: neither a unigram model nor a BPE model of plain pieces")
    all_bytes = kind.byte_fallback and sum(p.type == piece.BYTE for p in model.pieces) == 256
    return Merges([(p.piece, p.score) for p in model.pieces if p.type == piece.NORMAL], all_bytes)


def _within_words(names) -> bool:
    """Whether no piece has the mark after another character, or a line end beside one."""
    return not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in names)


def _automaton(pieces: list[tuple[str, float]]):
    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    return automaton


class Counter:
    """Counts the pieces of texts; keeps word counts in a table of bounded size."""

    def __init__(self, vocabulary: Vocabulary, entries: int = TABLE_ENTRIES):
        self.automaton = _automaton(vocabulary.pieces)
        self.unknown_score, self.all_bytes = vocabulary.unknown_score, vocabulary.all_bytes
        self.singles = frozenset(p for p, _ in vocabulary.pieces if len(p) == 1)
        self._words(vocabulary.separable, entries)

    def _words(self, separable: bool, entries: int) -> None:
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+") if separable else None
        self.table: dict[str, int] = {}
        self.entries = entries

    def run(self, text: str) -> int:
        """The best segmentation's number of pieces."""
        return self._known(text) if self.singles.issuperset(text) else self._any(text)

    def _known(self, text: str) -> int:
        """Of a text each of whose characters is a piece."""
        score, count = [0.0] + [-inf] * len(text), [0] * (len(text) + 1)
        for end, (length, s) in self.automaton.iter(text):
            end += 1
            s += score[end - length]
            if s > score[end]:
                score[end] = s
                count[end] = count[end - length] + 1
        return count[-1]

    def _any(self, text: str) -> int:
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        end, value = next(matches, (n, None))
        for i in range(n):
            best, pieces, single, unk = None, 0, False, False
            while end == i:
                length, s = value
                start = i + 1 - length
                candidate = score[start] + s
                if best is None or candidate > best:
                    best, pieces = candidate, count[start] + 1
                single = single or length == 1
                end, value = next(matches, (n, None))
            if not single:
                candidate = score[i] + self.unknown_score
                if best is None or candidate > best:
                    best, unk = candidate, True
                    if self.all_bytes:
                        pieces = count[i] + len(text[i].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[i] + (not unknown[i])
            score[i + 1], count[i + 1], unknown[i + 1] = best, pieces, unk
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.cut is None:
            return self.run(marked)
        words = self.cut.findall(marked)
        counts = list(map(self.table.get, words))
        if None in counts:
            counts = [self._word(w) if n is None else n for w, n in zip(words, counts, strict=True)]
        return sum(counts)

    def _word(self, word: str) -> int:
        n = self.table.get(word)
        if n is None:
            n = self.run(word)
            if len(word) <= KEEP_CHARS:
                if len(self.table) >= self.entries:
                    self.table.clear()
                self.table[word] = n
        return n


class MergeCounter(Counter):
    """Counts the pieces that merging in order of rank leaves."""

    def __init__(self, merges: Merges, entries: int = TABLE_ENTRIES):
        self.ranks, self.all_bytes = merges.ranks, merges.all_bytes
        self._words(merges.separable, entries)

    def run(self, text: str) -> int:
        """Symbols are named by their first character; ``stop`` and ``before`` link them."""
        n, rank = len(text), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = [(-r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, end = heappop(agenda)
            if stop[a] != b or stop[b] != end:
                continue
            stop[a], stop[b], before[end] = end, 0, a
            if a and (r := rank(text[before[a] : end])) is not None:
                heappush(agenda, (-r, before[a], a, end))
            if end < n and (r := rank(text[a : stop[end]])) is not None:
                heappush(agenda, (-r, a, end, stop[end]))
        count, at, unknown = 0, 0, False
        while at < n:
            if stop[at] > at + 1 or text[at] in self.ranks:
                count, unknown = count + 1, False
            elif self.all_bytes:
                count += len(text[at].encode("utf-8", "surrogatepass"))
            else:
                count, unknown = count + (not unknown), True
            at = stop[at]
        return count


_COUNTERS: dict[str, Counter] = {}


def _counter(key: str, shared) -> Counter:
    """One counter per worker process and vocabulary, kept from task to task."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = shared.value.counter()
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | Merges) -> DataFrame:
    """doc_id and n_tokens of every whole text, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.without_dominated() if isinstance(vocabulary, Vocabulary) else vocabulary)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
