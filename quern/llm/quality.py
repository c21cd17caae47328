"""Quality rules as a short-circuit cascade.

Each rule is a condition on a text alone. ``plan`` runs every rule over a bounded sample
and measures the share of rows it rejects and the time it takes; the cascade then tests
rules by rejection per cost, highest first, inside one CASE expression, so a text that
a cheap rule rejects never reaches a dear one. The order follows measured times, so it
may differ between runs; it changes the work and the name of the rejecting rule, never
the verdict, which is that no rule rejects. Everything is built from DataFrame functions.

Defined cases: a null text has no words, no symbols and no lines, and is rejected for
having fewer than ten words. Repeated rows are judged alike. Extra columns stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

WHITE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _covered(grams: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Sorting (hash, start) puts equal windows side by side; the starts that have an
    equal neighbour are sorted again and their intervals added up.
    """
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])

    def total(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return let(pairs, lambda s: total(F.sort_array(repeated(s))))


def n_repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows found at least twice in the text."""

    def grams(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g, width))

    return let(words, lambda w: let(grams(w), count)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a text column to a condition; it must not be null."""

    name: str
    rejects: Callable[[Column], Column]


def _size(a: Column) -> Column:
    return F.size(a).cast("long")


#: The production rules. Thresholds are shares of words or of lines with a word.
RULES = (
    Rule("few_words", lambda t: _size(words_of(t)) < 10),
    Rule("repeated_windows", lambda t: let(words_of(t), lambda w: 100 * n_repeat_words(w) > 20 * _size(w))),
    Rule("symbols", lambda t: 10 * n_symbols(t) > _size(words_of(t))),
    Rule("word_length", lambda t: let(words_of(t), lambda w: (F.char_length(F.array_join(w, "")) < 2 * F.size(w)) | (F.char_length(F.array_join(w, "")) > 15 * F.size(w)))),
    Rule("repeated_lines", lambda t: let(lines_with_words(t), lambda x: 10 * n_dup_lines(x) > 3 * F.size(x))),
)


#: The rules that the contract's ``base_failed`` stands for.
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Estimate]:
    """Measure each rule on at most ``sample_rows`` rows and sort by rejection per cost."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.table(docs.select(F.col(text).alias("text")).limit(sample_rows), "sample")

    def timed(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.select(F.avg(condition.cast("int"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    timed(F.lit(False))
    base = timed(F.octet_length("text") < 0)[1]
    found = []
    for rule in rules:
        share, seconds = timed(rule.rejects(F.col("text")))
        found.append(Estimate(rule, share, max(seconds - base, 1e-3)))
    return sorted(found, key=lambda e: (-e.worth, e.seconds, e.rule.name))


def verdict(ordered: list[Estimate] | tuple[Rule, ...], text: Column) -> Column:
    """The name of the first rule that rejects, null for a kept text."""
    chain = None
    for item in ordered:
        rule = item.rule if isinstance(item, Estimate) else item
        chain = F.when(rule.rejects(text), rule.name) if chain is None else chain.when(rule.rejects(text), rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns as they were."""
    return docs.where(verdict(plan(docs, rules, sample_rows), F.col("text")).isNull())


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base figures of every row, whether the base rules fail it, and the cascade's verdict.

    The base figures are asked for whatever the verdict, and the base rules are conditions
    on them. Texts they pass go through the cascade of the other rules, in the measured
    order and only as far as the first that rejects.
    """
    ordered = [e.rule for e in plan(docs, rules, sample_rows) if e.rule.name not in BASE_RULES]
    figures = docs.select("doc_id", "text", words_of(F.col("text")).alias("w")).select(
        "doc_id", "text",
        _size(F.col("w")).alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(lines_with_words(F.col("text"))).alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The rules' conditions on a text, with the figures that the row has already.
    on_figures = {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }
    kept = F.when(failed, False)
    for rule in ordered:
        kept = kept.when(on_figures[rule.name] if rule.name in on_figures else rule.rejects(F.col("text")), False)
    return figures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.otherwise(True).alias("kept"))
