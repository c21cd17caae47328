"""Scalar functions on identifiers, paths and guards, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(name: Column) -> Column:
    """The last segment of a name qualified by ``::``, ``.`` or ``#``."""
    return F.element_at(F.split(name, "::|\\.|#"), -1)


def leaf_variants(name: Column) -> Column:
    return F.array_distinct(F.array(F.lower(name), F.lower(leaf(name))))


def indexable_leaves(kind: Column, name: Column) -> Column:
    """What a name is looked up by: itself and its parts after ``::`` and ``.``, in lower case.

    A branch whose name is an expression keeps only a leading identifier; blank names have none.
    """
    text = F.btrim(name)
    low = F.lower(text)
    variants = F.array(low, *(F.btrim(F.element_at(F.split(low, sep), -1)) for sep in ("::", "\\.")))
    head = F.array(F.lower(F.regexp_extract(text, "^[A-Za-z_][A-Za-z0-9_]*", 0)))
    found = F.when((kind == "BRANCH") & text.rlike(r"[()=!<>&|+\-*/%]"), head).otherwise(variants)
    return F.filter(F.array_distinct(found), lambda x: x != "")


#: Spellings of the two truth values, the stored one first.
TRUTHS = [("1", "true", "True", "TRUE"), ("0", "false", "False", "FALSE")]


def truth(value: Column) -> Column:
    """The stored spelling of a truth value; what is no spelling of true is 0."""
    return F.when(F.lower(F.btrim(value)).isin("1", "true"), "1").otherwise("0")


def truth_aliases(value: str) -> tuple[str, ...]:
    """All spellings of a truth value; other values stand for themselves."""
    said = value.strip()
    return next((t for t in TRUTHS if said in t or said.lower() == t[1]), (said,))


def query_classes(text: Column) -> dict[str, Column]:
    """Whether a request's text looks like a regex, names several identifiers, or is a sentence."""
    said = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = (said != "") & ~said.contains("=")
    rest = F.regexp_replace(F.regexp_replace(said, "[A-Za-z_][A-Za-z0-9_]*", ""), r"::|\.", "")
    several = plain & (F.size(identifiers(said)) > 1) & rest.rlike(r"\S")
    return {"regex": text.rlike(r"\||\.\*"), "several": several, "sentence": several | (plain & said.rlike(r"[\u4e00-\u9fff]|\s"))}


def slug(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"))


def normal_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "\\s+", " "))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^(\\./)+", "")


def path_layer(path: Column) -> Column:
    """0 host, 1 kernel, 2 common, 3 other; common is tested first."""
    part = lambda name: path.rlike(f"(^|/){name}(/|$)")
    return F.when(part("common"), 2).when(part("op_host"), 0).when(part("op_kernel"), 1).otherwise(3)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def minted_id(prefix: str, *parts: Column) -> Column:
    """A stable id; null parts count as empty, so they keep their place."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.upper(F.sha2(joined, 256)), 1, 12))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("R_"), kind, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", kind, src, dst)), 1, 12))


def integer_text(literal: Column) -> Column:
    """Hexadecimal, binary and suffixed integer literals as decimal text."""
    bare = F.regexp_replace(literal, "[uUlL]+$", "")
    return (
        F.when(bare.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(bare, 3, 64), 16, 10))
        .when(bare.rlike("^0[bB][01]+$"), F.conv(F.substring(bare, 3, 64), 2, 10))
        .otherwise(bare)
    )


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``**`` spans folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + ("[^/]*" if "**" in glob else ".*"), i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def path_matches(path: Column, glob: str) -> Column:
    """Without wildcards a substring test; otherwise the whole path or its last part."""
    if not any(c in glob for c in "*?"):
        return path.contains(glob)
    pattern = glob_regex(glob)
    return path.rlike(pattern) | (F.element_at(F.split(path, "/"), -1).rlike(pattern) if "/" not in glob else F.lit(False))


def name_like(name: Column, pattern: str) -> Column:
    """``*`` and ``?`` wildcards as LIKE; otherwise a substring."""
    if not any(c in pattern for c in "*?"):
        return name.contains(pattern)
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern)
    return name.like(escaped.replace("*", "%").replace("?", "_"))


def same_path(left: Column, right: Column) -> Column:
    """Equal after normalisation, or one the tail of the other at a folder."""
    a, b = normal_path(left), normal_path(right)
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def rel_path(path: Column, root: str) -> Column:
    """A path below ``root`` with forward slashes; others stay whole."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), f"^{re.escape(root.rstrip('/'))}/", "")


def identifier_parts(name: Column) -> Column:
    """Lower-cased words of an identifier, cut at case changes, digits and underscores."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


#: Names that say nothing of the subject.
NOISE = r"^(std::.*|operator\W.*|if|for|while|switch|return|do|else|case|OP_CHECK\w*|OP_LOG\w*)$"


def is_noise(name: Column) -> Column:
    return name.rlike(NOISE)
