"""Facts of source text, line by line: functions, blocks, calls, writes, guards.

Everything is a window or a pattern over (path, line, text); no file is gathered in one
value. Windows are per file, in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFINITION = r"^void (\w+::\w+)\("
WRITE = r"^\s*(?:auto )?((?:this->)?[A-Za-z_][\w.]*) \+?= (.*);\s*$"
CALL = r"([A-Za-z_]\w*)\("
GUARD = r"^\s*if \((.*)\) \{\s*$"
#: Words before a parenthesis that call nothing.
FLOW = ["if", "for", "while", "switch", "return"]


def _lines(keys: tuple[str, ...] = ("path",)):
    return Window.partitionBy(*keys).orderBy("line")


def last_seen(value: Column) -> Column:
    """The last non-null value up to and with this line of the file."""
    return F.last(value, ignorenulls=True).over(_lines().rowsBetween(Window.unboundedPreceding, 0))


def enclosing_function(lines: DataFrame) -> DataFrame:
    """Adds ``function``: the last definition begun, ended by the next preprocessor line."""
    text = F.col("text")
    event = F.when(text.rlike(DEFINITION), F.regexp_extract(text, DEFINITION, 1)).when(text.startswith("#define"), "")
    return lines.withColumn("function", F.nullif(last_seen(event), F.lit("")))


def functions(scanned: DataFrame) -> DataFrame:
    """(path, function, line_start, line_end)."""
    own = scanned.where("function IS NOT NULL").where(~F.col("text").rlike("^(template|//)"))
    return own.groupBy("path", "function").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"))


def bodies(scanned: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, function, text) of the lines between a definition and its end, comments cut."""
    return without_comments(inside(scanned.join(spans, ["path", "function"])))


def without_comments(body: DataFrame) -> DataFrame:
    return body.select("path", "line", "function", F.regexp_replace("text", "//.*", "").alias("text"))


def spanned(scanned: DataFrame) -> DataFrame:
    """Adds ``line_start`` and ``line_end`` of the function around, null outside of any."""
    own = F.when(F.col("function").isNotNull() & ~F.col("text").rlike("^(template|//)"), F.col("line"))
    whole = Window.partitionBy("path", "function")
    return scanned.withColumns({"line_start": F.min(own).over(whole), "line_end": F.max(own).over(whole)})


def inside(found: DataFrame) -> DataFrame:
    """``spanned`` lines between a function's definition and its end."""
    return found.where((F.col("line") > F.col("line_start")) & (F.col("line") < F.col("line_end")))


def within(scanned: DataFrame, spans: DataFrame) -> DataFrame:
    """``inside`` lines of functions whose spans are a table of their own.

    Spark deals rows in buckets by path anew for a join by more columns. This one is by
    path alone, with a map of each file's functions that is looked up line by line.
    """
    of = F.map_from_entries(F.collect_list(F.struct("function", F.struct("line_start", "line_end"))))
    files = spans.groupBy("path").agg(of.alias("spans")).hint("shuffle_hash")
    found = scanned.where("function IS NOT NULL").join(files, "path").withColumn("span", F.col("spans")[F.col("function")])
    return inside(found.select(*scanned.columns, "span.line_start", "span.line_end"))


def calls(body: DataFrame) -> DataFrame:
    """(path, line, function, callee), one row per call."""
    found = body.select("path", "line", "function", F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("callee"))
    return found.where(~F.col("callee").isin(FLOW))


def writes(body: DataFrame) -> DataFrame:
    """(path, line, function, lhs, rhs) of assignments."""
    text = F.col("text")
    return body.where(text.rlike(WRITE)).select("path", "line", "function", F.regexp_extract(text, WRITE, 1).alias("lhs"), F.regexp_extract(text, WRITE, 2).alias("rhs"))


def blocks(lines: DataFrame) -> DataFrame:
    """(path, line_start, line_end, level, header) of brace blocks.

    A line's net braces are summed along the file. At each level openings and closings
    take turns, so a block ends at the next line of its level. Lines that change no depth
    are left out first, and so is the text of those that close.
    """
    count = lambda brace: F.char_length("text") - F.char_length(F.translate("text", brace, ""))
    opens = F.col("o") > F.col("c")
    turns = lines.withColumns({"o": count("{"), "c": count("}")}).where("o <> c").withColumn("text", F.when(opens, F.col("text")))
    deep = turns.withColumn("after", F.sum(F.col("o") - F.col("c")).over(_lines()))
    edges = deep.withColumn("level", F.when(opens, F.col("after")).otherwise(F.col("after") + 1)).withColumn("opens", opens)
    ended = edges.withColumn("line_end", F.lead("line").over(_lines(("path", "level"))))
    return ended.where("opens AND line_end IS NOT NULL").select("path", F.col("line").alias("line_start"), "line_end", F.col("level").cast("int").alias("level"), F.col("text").alias("header"))


def guards(found: DataFrame) -> DataFrame:
    """(path, line_start, line_end, cond) of conditional blocks."""
    header = F.col("header")
    return found.where(header.rlike(GUARD)).select("path", "line_start", "line_end", F.regexp_extract(header, GUARD, 1).alias("cond"))


def facts(body: DataFrame) -> DataFrame:
    """(path, line, function, fact, name): calls, members written, aliases made, buffers used."""
    text = F.col("text")
    of = lambda fact, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(fact).alias("fact"), n.alias("name")))
    every = F.concat(of("call", CALL), of("member", r"this->([A-Za-z_][\w.]*)"), of("alias", r"auto ([A-Za-z_]\w*) ="), of("buffer", r"\b(buf\d+)\."))
    found = body.select("path", "line", "function", F.explode(every).alias("x")).select("path", "line", "function", "x.fact", "x.name")
    return found.where(~F.col("name").isin(FLOW))


def facts_for(found: DataFrame, paths: list[str]) -> DataFrame:
    return found.where(F.col("path").isin(paths))


def comparisons(conds: DataFrame, cond: str = "cond") -> DataFrame:
    """Each simple comparison with an integer in a condition, split at ``&&`` and ``||``."""
    pattern = r"([A-Za-z_]\w*) (==|!=|>=|<=|>|<) (\d+)"
    parts = F.regexp_extract_all(cond, F.lit(pattern), F.lit(0))
    x = F.col("x")
    got = conds.withColumn("x", F.explode(parts))
    return got.select(*conds.columns, F.regexp_extract(x, pattern, 1).alias("field"), F.regexp_extract(x, pattern, 2).alias("op"), F.regexp_extract(x, pattern, 3).cast("int").alias("value"))
