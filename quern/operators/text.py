"""Search over source lines: literal and regex matching, ranking, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import path_layer, path_matches
from quern.functions.source_text import squashed

_META = set(r"\.^$*+?{}[]|()")


def is_literal(pattern: str) -> bool:
    return not any(c in _META for c in pattern)


def required_literals(pattern: str) -> list[str]:
    """One literal of three characters or more per top-level branch, or none if unprovable."""
    if any(c in pattern for c in "()[]{}\\"):
        return []
    out = []
    for branch in pattern.split("|"):
        parts = [p for p in re.split(r".[*?]|[.^$+]", branch) if len(p) >= 3]
        if not parts:
            return []
        out.append(max(parts, key=len))
    return out


def matching(lines: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Pure literals match whatever the case; a regex is tested after its literals."""
    text = F.col(column)
    if is_literal(pattern):
        return lines.where(F.lower(text).contains(pattern.lower()))
    literals, regex = required_literals(pattern), text.rlike(pattern.replace("(?P<", "(?<"))
    if not literals:
        return lines.where(regex)
    sieve = F.lit(False)
    for x in literals:
        sieve = sieve | text.contains(x)
    return lines.where(sieve & regex)


def line_role(text: Column) -> Column:
    """0 assignment, 1 call, 2 list item, 3 sentence, 4 other; the first that fits."""
    return (
        F.when(text.rlike("[A-Za-z_]\\s*=[^=]"), 0).when(text.rlike("[A-Za-z_]\\("), 1).when(text.rlike("^\\s*[-*|#]"), 2)
        .when(text.rlike("\\.\\s*$"), 3).otherwise(4)
    )


def ranked(hits: DataFrame, pattern: str) -> DataFrame:
    tight = F.when(F.col("text").rlike(f"\\b{re.escape(pattern)}\\b"), 0).otherwise(1) if is_literal(pattern) else F.lit(1)
    return hits.select("path", "line", line_role(F.col("text")).alias("role"), tight.alias("tightness"), path_layer(F.col("path")).alias("layer"))


def all_tokens(lines: DataFrame, tokens: list[str]) -> DataFrame:
    keep = F.lit(True)
    for t in tokens:
        keep = keep & F.lower("text").contains(t.lower())
    return lines.where(keep)


def suggestions(lines: DataFrame, tokens: list[str]) -> DataFrame:
    """How many lines each token would find alone, in one pass."""
    found = [F.count_if(F.lower("text").contains(t.lower())).alias(t) for t in tokens]
    counted = lines.agg(*found)
    pairs = F.array(*(F.struct(F.lit(t).alias("token"), F.col(f"`{t}`").alias("n")) for t in tokens))
    return counted.select(F.explode(pairs).alias("x")).select("x.token", "x.n")


def tagged(lines: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    """Lines with each phrase whose token they hold; the lexicon is a constant list."""
    tags = F.filter(F.array(*(F.when(F.col("text").contains(token), F.lit(phrase)) for phrase, token in lexicon)), lambda x: x.isNotNull())
    return lines.withColumn("phrase", F.explode(tags))


def expand(lines: DataFrame, keys: list[str], macros: DataFrame, rounds: int = 8) -> DataFrame:
    """Replaces names by their definitions (name, value), also inside definitions, ``rounds`` deep at most.

    Definitions are expanded among themselves first, so each line is cut and joined once.
    """
    word, other = "[A-Za-z_][A-Za-z0-9_]*", "[^A-Za-z_]+"

    def replaced(frame: DataFrame, ids: list[str], column: str, table: DataFrame) -> DataFrame:
        pieces = frame.select(*ids, F.posexplode(F.regexp_extract_all(column, F.lit(f"{word}|{other}"), F.lit(0))).alias("_at", "_piece"))
        swapped = pieces.join(table.select(F.col("name").alias("_piece"), F.col("value").alias("_value")), "_piece", "left")
        whole = swapped.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_value", "_piece").alias("p")))).alias("_x"))
        return whole.select(*ids, F.array_join("_x.p", "").alias(column))

    table, names = macros.select("name", "value"), macros.select(F.col("name").alias("_n"))
    for _ in range(rounds):
        used = table.select("name", F.explode(F.regexp_extract_all("value", F.lit(word), F.lit(0))).alias("_n")).join(names, "_n")
        if used.isEmpty():
            break
        table = replaced(table, ["name"], "value", macros)
    return replaced(lines, keys, "text", table)


def nearest_paths(files: DataFrame, glob: str, most: int = 6) -> DataFrame:
    """(pattern, nearest): none if the glob selects a file, else paths that hold its longest literal of four characters or more that any path holds."""
    keys = [re.sub("[^a-z0-9]", "", x.lower()) for x in sorted(re.split(r"[*?/\[\]]+", glob), key=len, reverse=True)]
    keys = [k for k in keys if len(k) >= 4]
    if not keys or not files.where(path_matches(F.col("path"), glob)).isEmpty():
        return files.sparkSession.createDataFrame([], "pattern string, nearest array<string>")
    level = F.coalesce(*(F.when(squashed(F.col("path")).contains(k), i) for i, k in enumerate(keys)), F.lit(None))
    hit = files.select(level.alias("level"), "path").where("level IS NOT NULL").orderBy("level", "path").limit(most)
    listed = hit.groupBy(F.lit(glob).alias("pattern")).agg(F.min("level").alias("best"), F.array_sort(F.collect_list(F.struct("level", "path"))).alias("x"))
    return listed.select("pattern", F.filter("x", lambda r: r["level"] == F.col("best"))["path"].alias("nearest"))


def source_role(text: Column) -> Column:
    """0 definition or member write, 1 assignment, 2 control, 3 other, 4 comment."""
    bare = F.btrim(text)
    return (
        F.when(bare.rlike("^(//|/\\*|\\*)"), 4).when(bare.rlike("^(if|for|while|switch)\\b"), 2).when(text.rlike("this->\\w|\\bset_\\w+\\("), 0)
        .when(bare.rlike("^(void|template|class|struct|enum|using|typedef)\\b"), 0).when(text.rlike("\\w\\s*\\+?=[^=]"), 1).otherwise(3)
    )


def ranked_source(hits: DataFrame, pattern: str) -> DataFrame:
    """Hits with role, tightness (0 where a name of the pattern is a whole word) and layer."""
    idents = re.findall("[A-Za-z_][A-Za-z0-9_]*", pattern)
    whole = F.lit(False)
    for name in idents:
        whole = whole | F.col("text").rlike(f"\\b{re.escape(name)}\\b")
    return hits.select("path", "line", source_role(F.col("text")).alias("role"), F.when(whole, 0).otherwise(1).alias("tightness"), path_layer(F.col("path")).alias("layer"))


def search(found: DataFrame, pattern: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of the ranked hits among ``found``, the lines that match, with their positions and the exact total."""
    literal = pattern if is_literal(pattern) else ""
    hits = ranked_source(found, literal)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    order = ["role", "tightness", "layer", "path", "line"]
    page = hits.orderBy(*order).limit(offset + limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return page.where(F.col("position") > offset).join(F.broadcast(total))
