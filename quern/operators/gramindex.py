"""Regex search through a stored index of trigrams.

A posting holds a gram, a block of a file and the lines of the block that have the gram;
postings are stored by gram in ``PARTS`` folders, so a search reads the folders of its
grams alone. A pattern's syntax tree becomes an AND/OR tree of the grams that every match
must hold. The tree is evaluated on whole blocks by intersecting and uniting their line
lists, and the pattern is tested on the lines that are left. A pattern of which no gram
can be proved is searched for in all lines.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import path_matches
from quern.operators.text import matching

PARTS = 64
BLOCK = 1024
#: Characters whose grams are sorted at once in a task.
CHARS = 1 << 20
#: Strings that a part of a pattern is followed as, at most; beyond, it is taken for unknown.
STRINGS = 24
#: Grams met for a conjunction, the rarest; the others can only confirm them.
RAREST = 3
#: Files up to which the lines are read by the names of their files.
FILES = 1000


def part_of(gram: Column) -> Column:
    return (F.crc32(gram) % PARTS).cast("int")


def build(lines: DataFrame) -> DataFrame:
    """(gram, path, block, lines, n, part) of (path, line, text), whatever the case; to be stored by ``part``.

    Lines are met where they lie and no row is dealt: a block whose lines come in several
    batches has several postings of a gram. Postings are in the order of their grams per batch.
    """
    rows = lines.where("path IS NOT NULL").select("path", F.col("line").cast("int").alias("line"), F.lower("text").alias("text")).where(F.length("text") >= 3)
    posted = rows.mapInArrow(_posted, "gram string, path string, block int, lines array<int>")
    return posted.select("gram", "path", "block", "lines", F.size("lines").alias("n"), part_of(F.col("gram")).alias("part"))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each batch of (path, line, text), in runs of about ``CHARS`` characters."""
    for batch in batches:
        named = batch.column("path").dictionary_encode()
        file, line = named.indices.to_numpy(), batch.column("line").to_numpy()
        order = np.lexsort((line, file))
        file, line, texts = file[order], line[order], batch.column("text").take(pa.array(order))
        long = pc.utf8_length(texts).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(long) // CHARS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            if a < b:
                # Taken again, so that the run's characters are a buffer of their own.
                yield _run(texts.take(pa.array(np.arange(a, b))), long[a:b], file[a:b], line[a:b], named.dictionary)


def _run(texts: pa.Array, long: np.ndarray, file: np.ndarray, line: np.ndarray, paths: pa.Array) -> pa.RecordBatch:
    """The postings of some lines in the order of their files and numbers, by gram.

    A gram and its line are one number of the ranks of its characters among those of the
    run and of the line, so that one sort puts both in order.
    """
    data = texts.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(texts)).as_py()]
    code = np.frombuffer(data, np.uint8) if len(data) == long.sum() else np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    there = np.zeros(int(code.max()) + 1, bool)
    there[code] = True
    letters, rank = np.flatnonzero(there), (np.cumsum(there) - 1).astype(np.uint64)[code]
    of_letter, of_line = len(letters).bit_length(), len(texts).bit_length()
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), long)
    whole = owner[2:] == owner[:-2]
    bits = np.uint64(of_letter)
    key = ((rank[:-2] << bits | rank[1:-1]) << bits | rank[2:])[whole]
    known = None
    if 3 * of_letter + of_line > 64:  # very many different characters: grams are ranked first
        known, key = np.unique(key, return_inverse=True)
        key = key.astype(np.uint64)
    both = key << np.uint64(of_line) | owner[2:][whole]
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]]
    gram, at = both >> np.uint64(of_line), (both & np.uint64((1 << of_line) - 1)).astype(np.int64)
    block = line[at] // BLOCK
    opens = np.r_[True, gram[1:] != gram[:-1]]
    starts = np.flatnonzero(opens | np.r_[True, (np.diff(file[at]) != 0) | (np.diff(block) != 0)])
    keys = gram[opens] if known is None else known[gram[opens].astype(np.int64)]
    mask = np.uint64((1 << of_letter) - 1)
    chars = [letters[(keys >> (bits * np.uint64(i)) & mask).astype(np.int64)].tolist() for i in (2, 1, 0)]
    grams = pa.array([chr(x) + chr(y) + chr(z) for x, y, z in zip(*chars, strict=True)], pa.string())
    held = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)], pa.int32()), pa.array(line[at], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [grams.take(pa.array(np.cumsum(opens)[starts] - 1)), paths.take(pa.array(file[at][starts])), pa.array(block[starts], pa.int32()), held], ["gram", "path", "block", "lines"]
    )


# -- patterns -------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """``op`` is gram, and, or, or any: what lines must hold. Any says nothing."""

    op: str
    gram: str = ""
    args: tuple[Tree, ...] = ()

    def grams(self) -> set[str]:
        return {self.gram} if self.op == "gram" else set().union(*(a.grams() for a in self.args), set())


ANY = Tree("any")


def both(*trees: Tree) -> Tree:
    flat = [b for a in trees for b in (a.args if a.op == "and" else (a,)) if b.op != "any"]
    kept = tuple(dict.fromkeys(flat))
    return ANY if not kept else kept[0] if len(kept) == 1 else Tree("and", args=kept)


def either(*trees: Tree) -> Tree:
    if not trees or any(t.op == "any" for t in trees):
        return ANY
    kept = tuple(dict.fromkeys(b for a in trees for b in (a.args if a.op == "or" else (a,))))
    return kept[0] if len(kept) == 1 else Tree("or", args=kept)


def holding(strings: set[str]) -> Tree:
    """What a line with one of these strings must hold."""
    return either(*(both(*(Tree("gram", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


Known = tuple[set[str] | None, Tree]
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _letter(code: int) -> set[str] | None:
    """A letter in lower case. Others than ASCII are left open: their case may depend on their place."""
    return {chr(code).lower()} if code < 128 else None


def _class(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            codes = [value]
        elif op is sre.RANGE and value[1] - value[0] < STRINGS:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        for code in codes:
            letter = _letter(code)
            if letter is None:
                return None
            out |= letter
    return out if len(out) <= STRINGS else None


def _item(op, value) -> Known:
    """(all strings that the item may match or None, what any match holds besides)."""
    if op is sre.LITERAL:
        return _letter(value), ANY
    if op is sre.IN:
        return _class(value), ANY
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ANY
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.ATOMIC_GROUP:
        return _sequence(value)
    if op is sre.BRANCH:
        arms = [_sequence(x) for x in value[1]]
        if all(s is not None and q is ANY for s, q in arms):
            union = set().union(*(s for s, _ in arms))
            if len(union) <= STRINGS:
                return union, ANY
        return None, either(*(both(q, holding(s) if s is not None else ANY) for s, q in arms))
    if op in _REPEATS:
        least, most, inner = value
        strings, tree = _sequence(inner)
        if least == 0:
            return (strings | {""}, ANY) if most == 1 and strings is not None and tree is ANY else (None, ANY)
        if least == most == 1:
            return strings, tree
        return None, both(tree, holding(strings) if strings is not None else ANY)
    return None, ANY


def _sequence(items) -> Known:
    run: set[str] = {""}
    tree, whole = ANY, True
    for op, value in items:
        strings, inner = _item(op, value)
        tree = both(tree, inner)
        if strings is None and op in _REPEATS and value[0] > 0 and (once := _sequence(value[2])[0]) is not None and len(run) * len(once) <= STRINGS:
            # What is repeated follows the run at its first time, and leads the next at its last.
            tree, whole, run = both(tree, holding({a + b for a in run for b in once})), False, once
            continue
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        tree, whole = both(tree, holding(run)), False
        run = strings if strings is not None else {""}
    return (run, tree) if whole else (None, both(tree, holding(run)))


def required(pattern: str) -> Tree:
    """The grams that every match of ``pattern`` holds, in lower case; ANY if none can be proved."""
    try:
        strings, tree = _sequence(parser.parse(pattern.replace("(?<", "(?P<") if "(?<=" not in pattern and "(?<!" not in pattern else pattern))
    except (re.error, RecursionError, OverflowError):
        return ANY
    return both(tree, holding(strings) if strings is not None else ANY)


# -- search ---------------------------------------------------------------------------


def _rarest(tree: Tree, n: dict[str, int]) -> Tree:
    """Conjunctions cut to their rarest grams; lines that this lets through are tested anyway."""
    if tree.op != "and":
        return Tree(tree.op, tree.gram, tuple(_rarest(a, n) for a in tree.args))
    grams = sorted((a for a in tree.args if a.op == "gram"), key=lambda a: (n.get(a.gram, 0), a.gram))[:RAREST]
    return both(*grams, *(_rarest(a, n) for a in tree.args if a.op != "gram"))


def postings(index: DataFrame, grams: set[str]) -> DataFrame:
    """The postings of some grams; only their folders are read."""
    parts = sorted({zlib.crc32(g.encode()) % PARTS for g in grams})
    return index.where(F.col("part").isin(parts) & F.col("gram").isin(sorted(grams)))


def candidates(index: DataFrame, tree: Tree) -> DataFrame:
    """(path, found): by block, the lines of each file that satisfy ``tree``."""
    n = {r.gram: r.n for r in postings(index, tree.grams()).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row per gram of the pattern
    tree = _rarest(tree, n)
    grams = sorted(tree.grams())
    held = [F.array_distinct(F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("lines"))))).alias(f"g{i}") for i, g in enumerate(grams)]
    blocks = postings(index, set(grams)).repartition("path").groupBy("path", "block").agg(*held)

    def lines(t: Tree) -> Column:
        if t.op == "gram":
            return F.col(f"g{grams.index(t.gram)}")
        return reduce(F.array_intersect if t.op == "and" else F.array_union, (lines(a) for a in t.args))

    hit = blocks.select("path", "block", lines(tree).alias("lines")).where(F.size("lines") > 0)
    return hit.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("block", "lines"))).alias("found"))


def search(lines: DataFrame, index: DataFrame | None, pattern: str, file: str | None = None) -> DataFrame:
    """The lines that match ``pattern``, in files that ``file`` selects.

    Of a pattern with provable grams only lines that hold them are read and tested;
    without such grams, or without an index, all are.
    """
    tree = required(pattern)
    scope = lines.where(path_matches(F.col("path"), file)) if file else lines
    if index is None or tree.op == "any":
        return matching(scope, pattern)
    found = candidates(index, tree)
    if file:
        found = found.where(path_matches(F.col("path"), file))
    paths = [r.path for r in found.select("path").distinct().limit(FILES + 1).collect()]
    if len(paths) <= FILES:  # else too many to name
        scope = scope.where(F.col("path").isin(paths))
    # By file alone: lines in buckets by file stay where they are.
    block = F.floor(F.col("line") / BLOCK).cast("int")
    return matching(scope.join(found, "path").where(F.array_contains(F.element_at("found", block), F.col("line"))).select(*scope.columns), pattern)
