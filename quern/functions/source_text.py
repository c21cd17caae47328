"""Scalar functions on source text: parentheses, comments, arguments, guards, literals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vectors import vector

_ATOM = re.compile(r"^[A-Za-z_][\w.:]*(?:->[\w.]+)*(?:\([^()]*\))?$")
_PARENS = re.compile(r"[()]")
#: How deep parentheses may nest for the tests made by patterns alone.
NESTING = 8


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``, or -1."""
    depth = 0
    for m in _PARENS.finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def plain_negation(text: str) -> str:
    """Drops what ``!`` needs no parentheses for and double negations; changes no meaning."""
    text, before = text.strip(), None
    while text != before:
        before = text
        if not text.startswith("!(") or closing(text, 1) != len(text) - 1:
            break
        inner = text[2:-1].strip()
        if _ATOM.match(inner):
            text = f"!{inner}"
        elif inner.startswith("!"):
            term = inner[1:].strip()
            if _ATOM.match(term) or (term.startswith("(") and closing(term, 0) == len(term) - 1):
                text = term
    return text


@vector("string")
def simplify_negation(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain_negation(t))


def needs_parens(cond: Column) -> Column:
    """Whether an ``||`` stands outside all parentheses."""
    for _ in range(NESTING):
        cond = F.regexp_replace(cond, r"\([^()]*\)", "")
    return cond.contains("||")


def joined_guards(guards: Column) -> Column:
    """Conditions joined by ``&&``: loop headers dropped, disjunctions in parentheses."""
    kept = F.filter(guards, lambda g: ~g.rlike(r"^(for|while|do|switch)\s*\(") & (g != ""))
    return F.array_join(F.transform(kept, lambda g: F.when(needs_parens(g), F.concat(F.lit("("), g, F.lit(")"))).otherwise(g)), " && ")


def split_top(text: str) -> list[str]:
    """Arguments of a list, cut at commas outside brackets and strings."""
    out, depth, start, quote, i = [], 0, 0, "", 0
    while i < len(text):
        ch = text[i]
        if quote:
            i += ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth -= 1
        elif ch == "," and depth <= 0:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


def call_arguments(text: str, callee: str) -> list[str] | None:
    m = re.search(rf"\b{re.escape(callee)}\s*\(", text)
    end = closing(text, m.end() - 1) if m else -1
    return split_top(text[m.end() : end]) if end > 0 else None


@vector("array<string>")
def arguments(texts: pd.Series, callees: pd.Series) -> pd.Series:
    return pd.Series([call_arguments(t, c) for t, c in zip(texts, callees, strict=True)], dtype=object)


#: What begins a string or a comment; most lines have none.
_MARKS = re.compile(r"[\"'/]")


def masked(text: str, in_block: bool = False) -> tuple[str, bool]:
    """Comments and string contents as spaces, every other character in its place."""
    if not in_block and not _MARKS.search(text):
        return text, False
    out, i, quote = [], 0, ""
    while i < len(text):
        two = text[i : i + 2]
        if in_block:
            in_block = two != "*/"
            step = 1 if in_block else 2
            out.append(" " * step)
        elif quote:
            step = 2 if text[i] == "\\" else 1
            out.append(text[i] if text[i] == quote else " " * step)
            quote = "" if text[i] == quote else quote
        elif two == "//":
            step = len(text) - i
            out.append(" " * step)
        elif two == "/*":
            step, in_block = 2, True
            out.append("  ")
        else:
            step = 1
            quote = text[i] if text[i] in "\"'" else ""
            out.append(text[i])
        i += step
    return "".join(out)[: len(text)], in_block


@vector("string")
def mask(texts: pd.Series) -> pd.Series:
    """Masks each text by itself: a line, or a whole file joined by line ends."""
    return texts.map(lambda t: None if t is None else masked(t)[0])


def occupancy(expr: Column) -> Column:
    """Integers of a constant scalar or brace list, sorted; none of any other text."""
    found = F.transform(F.regexp_extract_all(expr, F.lit(r"[+-]?\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(expr.rlike(r"^[\d\s{}(),+-]+$"), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<long>"))


def worth_sharing(common: Column, left: Column, right: Column) -> Column:
    """Common values other than 0 and 1, or any if both sides are lists."""
    telling = F.size(F.array_except(common, F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))) > 0
    return (F.size(common) > 0) & (telling | (left.contains("{") & right.contains("{")))


def plain_symbol(name: Column) -> Column:
    """``this->a.b`` and ``(*this).a->b`` as ``a.b``."""
    return F.regexp_replace(F.regexp_replace(name, r"^\(?\*?this\)?(->|\.)", ""), "->", ".")


def short_symbol(name: Column) -> Column:
    return F.element_at(F.split(plain_symbol(name), r"::|\."), -1)


def is_member(name: Column) -> Column:
    return name.rlike(r"^\(?\*?this\)?(->|\.)") | F.regexp_replace(name, "^.*(::|\\.|->)", "").endswith("_")


def squashed(path: Column) -> Column:
    """A path without case, separators and punctuation."""
    return F.regexp_replace(F.lower(path), "[^a-z0-9]", "")


def dim_aliases(name: Column) -> Column:
    """Spellings under which a flag may be stored, in the order they are tried."""
    low, cap = F.lower(name), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))
    has, is_ = F.substring(name, 4, 1000), F.substring(name, 3, 1000)
    turned = (
        F.when(low.startswith("has") & (F.length(name) > 3), F.array(F.concat(F.lit("Is"), cap(has)), F.concat(F.lit("is"), has)))
        .when(low.startswith("is") & (F.length(name) > 2), F.array(F.concat(F.lit("has"), cap(is_)), F.concat(F.lit("Has"), cap(is_))))
        .otherwise(F.array().cast("array<string>"))
    )
    number = F.when(name.endswith("Num"), F.regexp_replace(name, "Num$", "")).otherwise(F.concat(name, F.lit("Num")))
    every = F.concat(F.array(name), turned, F.array(number))
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)
