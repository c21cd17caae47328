"""Macro expansion with parameters: rescanning with a hide set per token.

A definition is (name, parameters or None, body). An argument is expanded before it is put
in place of its parameter, unless it is pasted (``##``) or quoted (``#``). What a macro's
expansion yields is read again with what follows it; a name that the expansion has come
from is not expanded again. The last parameter ``...`` takes all further arguments as
``__VA_ARGS__``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd

from quern.functions.vectors import vector

_TOKEN = re.compile(r'\s+|[A-Za-z_]\w*|\.?\d(?:[\w.]|[eEpP][+-])*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|##|::|->|<<|>>|[<>=!]=|&&|\|\||\+\+|--|.', re.S)
_NAME = re.compile(r"[A-Za-z_]\w*\Z")
#: An expansion that grows beyond so many characters is given up.
MOST = 1 << 16


class TooLong(ValueError):
    """The expansion would pass the bound."""


@dataclass(frozen=True)
class Token:
    text: str
    hidden: frozenset[str] = frozenset()

    @property
    def blank(self) -> bool:
        return self.text.isspace()


Definition = tuple[list[str] | None, str]


def tokens(text: str, hidden: frozenset[str] = frozenset()) -> list[Token]:
    return [Token(m[0], hidden) for m in _TOKEN.finditer(text)]


def _arguments(rest: list[Token]) -> tuple[list[list[Token]], Token, list[Token]] | None:
    """(arguments, closing parenthesis, what follows) if ``rest``, reversed, begins with a call."""
    at = len(rest) - 1
    while at >= 0 and rest[at].blank:
        at -= 1
    if at < 0 or rest[at].text != "(":
        return None
    args, depth, i = [[]], 1, at - 1
    while i >= 0:
        t = rest[i]
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        if depth == 0:
            return [_stripped(a) for a in args], t, rest[:i]
        if t.text == "," and depth == 1:
            args.append([])
        else:
            args[-1].append(t)
        i -= 1
    return None


def _stripped(row: list[Token]) -> list[Token]:
    a, b = 0, len(row)
    while a < b and row[a].blank:
        a += 1
    while b > a and row[b - 1].blank:
        b -= 1
    return row[a:b]


def _joined(row: list[Token]) -> str:
    return "".join(" " if t.blank else t.text for t in row)


class Expander:
    def __init__(self, definitions: dict[str, Definition], most: int = MOST):
        self.definitions, self.most, self.spent = definitions, most, 0

    def expand(self, row: list[Token]) -> list[Token]:
        out, rest = [], list(reversed(row))
        while rest:
            t = rest.pop()
            found = self.definitions.get(t.text) if t.text not in t.hidden else None
            if found is None:
                out.append(t)
                continue
            params, body = found
            if params is None:
                new = self.body(body, {}, t.hidden | {t.text})
            else:
                call = _arguments(rest)
                bound = self.bind(params, call[0]) if call else None
                if bound is None:
                    out.append(t)
                    continue
                new, rest = self.body(body, bound, (t.hidden & call[1].hidden) | {t.text}), call[2]
            self.spent += sum(len(x.text) for x in new) + 1
            if self.spent > self.most:
                raise TooLong
            rest.extend(reversed(new))
        return out

    def bind(self, params: list[str], args: list[list[Token]]) -> dict[str, list[Token]] | None:
        """Parameters with their arguments; none if their numbers do not fit."""
        named = [p for p in params if p != "..."]
        if not params and args == [[]]:
            return {}
        if len(params) > len(named):
            extra = args[len(named) :]
            bound = dict(zip(named, args, strict=False))
            if len(args) < len(named):
                return None
            joined: list[Token] = []
            for i, a in enumerate(extra):
                joined += ([Token(","), Token(" ")] if i else []) + a
            return bound | {"__VA_ARGS__": joined}
        return dict(zip(named, args, strict=True)) if len(args) == len(named) else None

    def body(self, text: str, bound: dict[str, list[Token]], hidden: frozenset[str]) -> list[Token]:
        row, out, i = _stripped(tokens(text)), [], 0
        solid = [k for k, t in enumerate(row) if not t.blank]
        place = {k: n for n, k in enumerate(solid)}
        near = lambda k, by: row[solid[place[k] + by]].text if 0 <= place[k] + by < len(solid) else ""
        while i < len(row):
            t = row[i]
            if t.text == "#" and bound and near(i, 1) in bound:
                i = solid[place[i] + 1]
                out.append(Token('"' + _joined(bound[row[i].text]).replace("\\", "\\\\").replace('"', '\\"') + '"'))
            elif t.text == "##" and out:
                while out and out[-1].blank:
                    out.pop()
                if place[i] + 1 < len(solid):
                    i = solid[place[i] + 1]
                    right = list(bound.get(row[i].text, [row[i]]))
                    left = out.pop() if out else Token("")
                    head = right[0] if right else Token("")
                    out += [x for x in [Token(left.text + head.text, left.hidden & head.hidden), *right[1:]] if x.text]
            elif t.text in bound:
                pasted = near(i, 1) == "##" or near(i, -1) == "##"
                out += bound[t.text] if pasted else self.expand(bound[t.text])
                if not bound[t.text] and pasted:
                    out.append(Token(""))
            else:
                out.append(t)
            i += 1
        return [Token(t.text, t.hidden | hidden) for t in out if t.text]


def expanded(text: str, definitions: dict[str, Definition], most: int = MOST) -> str | None:
    """The text with its macros expanded; None if the expansion would pass ``most`` characters."""
    try:
        return "".join(t.text for t in Expander(definitions, most).expand(tokens(text)))
    except (TooLong, RecursionError):
        return None


def definition(line: str) -> tuple[str, list[str] | None, str] | None:
    """(name, parameters, body) of a ``#define`` line."""
    m = re.match(r"\s*#\s*define\s+([A-Za-z_]\w*)(\(([^()]*)\))?\s*(.*?)\s*\Z", line, re.S)
    if not m or (m[2] is None and line[m.end(1) : m.end(1) + 1] == "("):
        return None
    return m[1], None if m[2] is None else [p.strip() for p in m[3].split(",") if p.strip()], m[4]


@vector("struct<name:string,params:array<string>,body:string>")
def parse_definition(texts: pd.Series) -> pd.DataFrame:
    rows = [definition(t) or (None, None, None) for t in texts.fillna("")]
    return pd.DataFrame(rows, columns=["name", "params", "body"]).astype(object)


@vector("string")
def expand_with(texts: pd.Series, definitions: pd.Series) -> pd.Series:
    """Each text expanded with the definitions (name, params, body) of its row."""
    known = lambda rows: {d["name"]: (None if d["params"] is None else list(d["params"]), d["body"]) for d in (rows if rows is not None else [])}
    return pd.Series([None if t is None else expanded(t, known(d)) for t, d in zip(texts, definitions, strict=True)], dtype=object)
