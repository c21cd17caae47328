"""Parsers of declaration texts, run in Arrow batches: domains, structs, operator definitions, settings."""

from __future__ import annotations

import re

import pandas as pd

from quern.functions.source_text import closing, split_top
from quern.functions.vectors import vector

_DECL = re.compile(r"\b(UINT|BOOL|DTYPE|FORMAT)_(DECL|SEL)\s*\(")
#: Bits of a domain whose declaration names no width.
WIDTHS = {"BOOL": 1, "DTYPE": 8, "FORMAT": 8}


def _body(text: str, at: int) -> str:
    end = closing(text, at)
    return text[at + 1 : end] if end > 0 else ""


def declared(text: str) -> list[dict]:
    """Domains of ``ARGS_DECL(tag, KIND_DECL(name, ...), ...)`` with their bit ranges, or of ``ARGS_SEL`` groups."""
    out = []
    for group, m in enumerate(re.finditer(r"\bARGS_(?:DECL|SEL)\s*\(", text)):
        body, low = _body(text, m.end() - 1), 0
        for d in _DECL.finditer(body):
            parts = split_top(_body(body, d.end() - 1))
            if not parts:
                continue
            explicit = d[1] == "UINT" and d[2] == "DECL"
            width = int(parts[1]) if explicit else WIDTHS.get(d[1], 8)
            out.append({"block": group, "name": parts[0], "kind": d[1], "bit_lo": low, "bit_hi": low + width - 1, "values": parts[2 if explicit else 1 :]})
            low += width
    return out


@vector("array<struct<block:int,name:string,kind:string,bit_lo:int,bit_hi:int,values:array<string>>>")
def parse_domains(texts: pd.Series) -> pd.Series:
    return pd.Series([declared(t or "") for t in texts], dtype=object)


def struct_fields(text: str) -> list[dict]:
    """Fields of macro structs (BEGIN_STRUCT ... END_STRUCT) and of plain structs and classes."""
    out = []
    for m in re.finditer(r"BEGIN_STRUCT\((\w+)\)(.*?)END_STRUCT", text, re.S):
        for i, f in enumerate(re.finditer(r"FIELD(_ARR)?\(([^)]*)\)", m[2])):
            parts = split_top(f[2])
            size = int(parts[1]) if f[1] else None
            out.append({"struct": m[1], "position": i, "type": parts[0], "field": parts[-1], "length": size})
    for m in re.finditer(r"\b(?:struct|class)\s+(\w+)\s*\{([^{}]*)\}", text):
        members = re.finditer(r"([A-Za-z_][\w:<>]*)\s+(\w+)(?:\[(\d+)\])?\s*(?:=\s*[^;]+)?;", m[2])
        out += [{"struct": m[1], "position": i, "type": f[1], "field": f[2], "length": int(f[3]) if f[3] else None} for i, f in enumerate(members)]
    return out


@vector("array<struct<struct:string,position:int,type:string,field:string,length:int>>")
def parse_structs(texts: pd.Series) -> pd.Series:
    return pd.Series([struct_fields(t or "") for t in texts], dtype=object)


def operator_params(text: str) -> list[dict]:
    """Input, Output and Attr declarations with the calls chained to them."""
    heads = list(re.finditer(r'\b(Input|Output|Attr)\("(\w+)"\)', text))
    out = []
    for m, after in zip(heads, [*heads, None][1:], strict=True):
        chain = text[m.end() : after.start() if after else len(text)]
        said = re.search(r"\.(?:ParamType|AttrType)\((\w+)\)", chain)
        types = re.search(r"\.DataType\(\{([^}]*)\}\)", chain)
        out.append({"role": m[1], "name": m[2], "required": bool(said) and said[1] == "REQUIRED", "types": split_top(types[1]) if types else []})
    return out


@vector("array<struct<role:string,name:string,required:boolean,types:array<string>>>")
def parse_operator(texts: pd.Series) -> pd.Series:
    return pd.Series([operator_params(t or "") for t in texts], dtype=object)
