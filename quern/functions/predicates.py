"""Predicate texts as trees and flat arrays, parsed in Arrow batches.

``parse`` is a precedence climber over C operators; a text it can't read is one RAW
node. Trees are JSON; operators, literals and references are stored as arrays, so that
filters on them stay inside Spark's own expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vectors import vector

#: Binary operators from loosest to tightest.
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", "<=", ">", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
#: Operator names.
NAMES = {
    "||": "OR", "&&": "AND", "|": "BITOR", "^": "BITXOR", "&": "BITAND", "==": "EQ", "!=": "NE", "<": "LT", "<=": "LE", ">": "GT", ">=": "GE",
    "<<": "SHL", ">>": "SHR", "+": "ADD", "-": "SUB", "*": "MUL", "/": "DIV", "%": "MOD",
}
#: Casts, which stand for their argument, and prefixes of enumerators.
CASTS = ["static_cast", "const_cast", "reinterpret_cast", "dynamic_cast"]
ENUM_PREFIXES = ["INPUT_FORMAT_", "LAYOUT_", "DT_", "PIPE_", "TPL_", "FORMAT_"]
_TOKEN = re.compile(
    r'\s*(?:(?P<num>0[xX][0-9a-fA-F]+|0[bB][01]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?P<suffix>[fFuUlL]*)|(?P<str>"[^"]*")|(?P<cast>(?:static|const|reinterpret|dynamic)_cast\s*<[^<>]*(?:<[^<>]*>[^<>]*)*>)'
    r"|(?P<ref>[A-Za-z_]\w*(?:(?:::|\.|->)[A-Za-z_]\w*)*)|(?P<op>\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%<>|^&!~(),?:\[\]]))"
)
_POWER = {op: i for i, row in enumerate(LEVELS) for op in row}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(text[at:])
        kind = next(k for k in ("num", "str", "cast", "ref", "op") if m[k] is not None)
        out.append(("float" if kind == "num" and _is_float(m[kind], m["suffix"]) else kind, m[kind]))
        at = m.end()
    return out


def _is_float(text: str, suffix: str) -> bool:
    return text[:2].lower() not in ("0x", "0b") and ("f" in suffix.lower() or any(c in text for c in ".eE"))


def enumerator(name: str) -> bool:
    """Whether a name is spelled like an enumerator: by its prefix, or in capitals."""
    return name.startswith(tuple(ENUM_PREFIXES)) or (len(name) > 1 and name.isupper())


class _Reader:
    def __init__(self, items: list[tuple[str, str]]):
        self.items, self.at = items, 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or (value is not None and item != ("op", value)):
            raise ValueError(item)
        self.at += 1
        return item

    def whole(self) -> dict:
        """A condition; of ``a ? b : c`` the three parts are kept as one call."""
        test = self.binary()
        if self.peek() != ("op", "?"):
            return test
        self.take("?")
        yes = self.whole()
        self.take(":")
        return {"op": "CALL", "value": "?:", "args": [test, yes, self.whole()]}

    def binary(self, least: int = 0) -> dict:
        left = self.unary()
        while self.peek()[0] == "op" and _POWER.get(self.peek()[1], -1) >= least:
            op = self.take()[1]
            left = {"op": NAMES[op], "args": [left, self.binary(_POWER[op] + 1)]}
        return left

    def unary(self) -> dict:
        kind, value = self.take()
        if kind == "op" and value in "!~-":
            return {"op": {"!": "NOT", "~": "BITNOT", "-": "NEG"}[value], "args": [self.unary()]}
        return self.trailed(self.primary(kind, value))

    def trailed(self, node: dict) -> dict:
        while self.peek() == ("op", "["):
            self.take("[")
            node = {"op": "CALL", "value": "[]", "args": [node, self.whole()]}
            self.take("]")
        return node

    def arguments(self) -> list[dict]:
        self.take("(")
        args = []
        while self.peek() != ("op", ")"):
            args.append(self.whole())
            if self.peek() == ("op", ","):
                self.take(",")
        self.take(")")
        return args

    def primary(self, kind: str, value: str) -> dict:
        if (kind, value) == ("op", "("):
            inner = self.whole()
            self.take(")")
            return inner
        if kind == "num":
            return {"op": "INT", "value": str(int(value, 0) if value[:1] != "0" or value[1:2].lower() in ("x", "b") else int(value))}
        if kind == "float":
            return {"op": "FLOAT", "value": value}
        if kind == "str":
            return {"op": "STR", "value": value[1:-1]}
        if kind == "cast":
            return self.arguments()[0]
        if kind != "ref":
            raise ValueError(value)
        leaf = re.split(r"::|\.|->", value)[-1]
        if leaf in ("true", "false"):
            return {"op": "BOOL", "value": leaf}
        if self.peek() != ("op", "("):
            return {"op": "ENUM", "value": leaf} if enumerator(leaf) else {"op": "REF", "value": value}
        args = self.arguments()
        return {"op": "STRCMP", "args": args} if leaf == "strcmp" else {"op": "CALL", "value": value, "args": args}


def parse(text: str) -> dict:
    try:
        bare = re.fullmatch(r"\s*(?:if|while|switch)\s*\((.*)\)\s*\{?\s*", text, re.S)
        head = re.fullmatch(r"\s*for\s*\([^;]*;([^;]*);[^;]*\)\s*\{?\s*", text, re.S)
        reader = _Reader(tokens((head or bare)[1] if head or bare else text))
        tree = reader.whole()
        if reader.peek()[0] != "end":
            raise ValueError
        return tree
    except (ValueError, IndexError):
        return {"op": "RAW", "value": text}


def flatten(tree: dict) -> dict:
    """The tree with its distinct operators, literals, references (by leaf) and enumerators, in the order they stand."""
    found: dict[str, list[str]] = {"operators": [], "literals": [], "references": [], "enum_values": []}

    def add(kind: str, value: str) -> None:
        if value not in ("", *found[kind]):
            found[kind].append(value)

    stack = [tree]
    while stack:
        node = stack.pop()
        op = node["op"]
        if op in ("INT", "FLOAT", "BOOL", "STR"):
            add("literals", node["value"])
            if op == "STR" and enumerator(node["value"]):
                add("enum_values", node["value"])
        elif op == "ENUM":
            add("enum_values", node["value"])
            for part in node["value"].split("_"):
                if len(part) > 1 and not part.isdigit():
                    add("enum_values", part)
        elif op == "REF":
            add("references", re.split(r"::|\.|->", node["value"])[-1])
        elif op != "RAW":
            add("operators", op)
        stack += reversed(node.get("args", []))
    return {"tree": json.dumps(tree), **found}


_ARRAYS = ("operators", "literals", "references", "enum_values")


@vector("struct<tree:string,operators:array<string>,literals:array<string>,references:array<string>,enum_values:array<string>>")
def parse_predicate(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([flatten(parse(t or "")) for t in texts], columns=["tree", *_ARRAYS])


def holds(parsed: Column, operator: str | None = None, literal: str | None = None, symbol: str | None = None, value: str | None = None) -> Column:
    """Whether a parsed predicate has an operator, a literal, a referenced symbol or an enumerator (whole or its last part)."""
    out = F.lit(True)
    if operator is not None:
        out &= F.array_contains(parsed["operators"], operator.upper())
    if literal is not None:
        out &= F.array_contains(parsed["literals"], literal)
    if symbol is not None:
        out &= F.exists(parsed["references"], lambda x: F.lower(x) == symbol.lower())
    if value is not None:
        out &= F.exists(parsed["enum_values"], lambda x: (F.lower(x) == value.lower()) | F.lower(x).endswith(f"_{value.lower()}"))
    return out


def evaluate(tree: dict, values: dict) -> float | int | bool | str | None:
    """Three-valued evaluation: an unknown reference is None; x / 0 and x % 0 are 0; / is true division."""
    op = tree["op"]
    if op == "INT":
        return int(tree["value"])
    if op == "FLOAT":
        return float(tree["value"])
    if op == "BOOL":
        return tree["value"] == "true"
    if op == "STR":
        return tree["value"]
    if op == "REF":
        return values.get(tree["value"])
    if op == "CALL" and tree["value"] == "?:":
        test = evaluate(tree["args"][0], values)
        return None if test is None else evaluate(tree["args"][1 if test else 2], values)
    if op in ("RAW", "CALL", "STRCMP", "ENUM"):
        return None
    args = [evaluate(a, values) for a in tree["args"]]
    if op in ("AND", "OR"):
        stop = op == "OR"
        if any(a is not None and bool(a) is stop for a in args):
            return stop
        return None if None in args else not stop
    if None in args:
        return None
    if op in ("DIV", "MOD") and args[1] == 0:
        return 0
    return {
        "EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GE": lambda a, b: a >= b,
        "ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b, "DIV": lambda a, b: a / b, "MOD": lambda a, b: a % b,
        "SHL": lambda a, b: a << b, "SHR": lambda a, b: a >> b, "BITAND": lambda a, b: a & b, "BITOR": lambda a, b: a | b, "BITXOR": lambda a, b: a ^ b,
        "NOT": lambda a: not a, "NEG": lambda a: -a, "BITNOT": lambda a: ~a,
    }[op](*args)


@vector("double")
def evaluate_text(texts: pd.Series) -> pd.Series:
    """The value of constant expressions, null where one is unknown; true is 1."""
    return texts.map(lambda t: None if (v := evaluate(parse(t or ""), {})) is None or isinstance(v, str) else float(v))


def axes(tree: dict) -> list[dict]:
    """Fields and shifts of a packing: an OR or sum of references, shifted or weighted by powers of two."""
    joins = {"BITOR", "ADD"}
    if tree["op"] in joins:
        found = [axes(a) for a in tree["args"]]
        return [x for part in found for x in part] if all(found) else []
    if tree["op"] == "REF":
        return [{"field": tree["value"], "shift": 0}]
    if tree["op"] not in ("SHL", "MUL") or tree["args"][1]["op"] != "INT":
        return []
    by, inner = int(tree["args"][1]["value"]), axes(tree["args"][0])
    if tree["op"] == "MUL" and (by <= 0 or by & (by - 1)):
        return []
    shift = by if tree["op"] == "SHL" else by.bit_length() - 1
    return [{"field": x["field"], "shift": x["shift"] + shift} for x in inner]


@vector("array<struct<field:string,shift:int>>")
def packed_axes(texts: pd.Series) -> pd.Series:
    return pd.Series([axes(parse(t or "")) for t in texts], dtype=object)


def register(spark) -> None:
    """Install the scalar functions under SQL names."""
    for name, f in {"parse_predicate": parse_predicate, "evaluate_text": evaluate_text, "packed_axes": packed_axes}.items():
        spark.udf.register(name, f.declared())
