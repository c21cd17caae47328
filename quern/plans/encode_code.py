"""The line items as source text: files of functions with guards, loops, writes and calls.

Eight orders are a file, an order is a function, and a line item is a block of four
lines whose form depends on its return flag. Facts about the text (enclosing functions,
brace blocks, calls, writes) are found by scanning it, not taken from the tables.
``CODE_SQL`` says the same for the oracles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.names import identifiers, leaf
from quern.functions.source_text import plain_symbol
from quern.operators import code, gramindex, merge
from quern.plans.encode import table
from quern.sources.snapshot import bucket_table, buckets, lookup_table

#: Per return flag the four lines of a block; names in braces are fields of the item.
BLOCKS = {
    "R": [
        "  if (size{a} > {q} && !(mode{b} == 1 || n{o} < 2)) {{", "    buf{b}.Set(v{a}, {q}, Pick(size{a}, {l}));",
        "    v{a} = size{a} + {l};", "  }}",
    ],
    "A": ["  for (int i = 0; i < {q}; i++) {{", "    total{b} += Get{a}(n{o}, i);", "    this->data_.f{a} = total{b};", "  }}"],
    "N": ["  OP_CHECK(v{a} != CAP{o}, return);", "  auto flag{b} = size{a} && mode{b};", "  Run{p}(flag{b}, false);", '  set_f{a}(v{a});  // write "f{a}"'],
}
#: Calls from which a name is looked for among the functions before its calls are dealt by name.
OFTEN = 1000
LAYERS = ["op_host", "op_kernel/arch35", "op_kernel/arch22", "op_host/common"]
FIELDS = {"a": "l_partkey % 50", "b": "l_suppkey % 10", "o": "l_orderkey", "p": "l_orderkey - 1", "s": "l_orderkey + 1", "q": "CAST(l_quantity AS INT)", "l": "l_linenumber"}


def _pieces(template: str, fields: dict[str, str] = FIELDS) -> list[str]:
    """A template as SQL operands: quoted text and field expressions by turns."""
    out, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        text, _, rest = rest.partition("{")
        if text:
            out.append("'" + text.replace("\0", "{").replace("\1", "}") + "'")
        if rest:
            field, _, rest = rest.partition("}")
            out.append(f"CAST({fields[field]} AS STRING)")
    return out


def _block_sql() -> str:
    """One row per line of a block: the four forms of each flag, as SQL both engines read."""
    rows = []
    for flag, lines in BLOCKS.items():
        for k, template in enumerate(lines):
            rows.append(f"SELECT l_orderkey AS o, j, {k} AS k, {' || '.join(_pieces(template))} AS text FROM item WHERE l_returnflag = '{flag}'")
    return " UNION ALL ".join(rows)


_PATH = "CASE floor(o / 8) % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LAYERS)) + " END || '/m' || CAST(CAST(floor(o / 8) AS BIGINT) AS STRING) || '.cpp'"
_HEADS = [
    "CASE WHEN o % 8 = 0 THEN '#define M' || CAST(CAST(floor(o / 8) AS BIGINT) AS STRING) || '_H_' ELSE '#define CAP' || CAST(o AS STRING) || ' ' || CAST(o % 9 AS STRING) END",
    """CASE WHEN o % 2 = 0 THEN 'template <typename T, int N>' ELSE '// order ' || CAST(o AS STRING) || ' says "run /* now */"' END""",
    "'void Op' || CAST(o % 7 AS STRING) || '::Run' || CAST(o AS STRING) || '(int n' || CAST(o AS STRING) || ', bool fast) {'",
]

TEXT_SQL = (
    "item AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS j FROM lineitem), "
    "head AS (SELECT DISTINCT l_orderkey AS o FROM lineitem), "
    "piece AS (" + _block_sql() + "".join(f" UNION ALL SELECT o, 0, {k}, {x} FROM head" for k, x in enumerate(_HEADS)) + " UNION ALL SELECT o, 1000000, 0, '}' FROM head), "
    f"code AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY o, j, k) AS INT) AS line, text FROM (SELECT {_PATH} AS path, o, j, k, text FROM piece))"
)

#: Facts for the oracles; the patterns are those of ``quern.operators.code``.
CODE_SQL = TEXT_SQL + r""",
scan AS (SELECT path, line, text, nullif(last_value(CASE WHEN regexp_matches(text, '^void \w+::\w+\(') THEN regexp_extract(text, '^void (\w+::\w+)\(', 1) WHEN starts_with(text, '#define') THEN '' END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS function FROM code),
fn AS (SELECT path, function, min(line) AS line_start, max(line) AS line_end FROM scan WHERE function IS NOT NULL AND NOT regexp_matches(text, '^(template|//)') GROUP BY path, function),
body AS (SELECT scan.* FROM scan JOIN fn USING (path, function) WHERE line > line_start AND line < line_end),
clean AS (SELECT path, line, function, regexp_replace(text, '//.*', '') AS text FROM body),
call AS (SELECT * FROM (SELECT path, line, function, unnest(regexp_extract_all(text, '([A-Za-z_]\w*)\(', 1)) AS callee FROM clean) WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'return')),
wr AS (SELECT path, line, function, regexp_extract(text, '^\s*(?:auto )?((?:this->)?[A-Za-z_][\w.]*) \+?= (.*);\s*$', 1) AS lhs, regexp_extract(text, '^\s*(?:auto )?((?:this->)?[A-Za-z_][\w.]*) \+?= (.*);\s*$', 2) AS rhs
  FROM clean WHERE regexp_matches(text, '^\s*(?:auto )?((?:this->)?[A-Za-z_][\w.]*) \+?= (.*);\s*$')),
delta AS (SELECT path, line, text, len(regexp_extract_all(text, '\{')) AS o, len(regexp_extract_all(text, '\}')) AS c FROM code),
deep AS (SELECT *, sum(o - c) OVER (PARTITION BY path ORDER BY line) AS after FROM delta),
edge AS (SELECT path, line, text, after AS level, true AS opens FROM deep WHERE o > c UNION ALL SELECT path, line, text, after + 1, false FROM deep WHERE c > o),
block AS (SELECT path, line AS line_start, line_end, level::INT AS level, text AS header FROM (SELECT *, lead(line) OVER (PARTITION BY path, level ORDER BY line) AS line_end FROM edge) WHERE opens AND line_end IS NOT NULL),
guard AS (SELECT path, line_start, line_end, regexp_extract(header, '^\s*if \((.*)\) \{\s*$', 1) AS cond FROM block WHERE regexp_matches(header, '^\s*if \((.*)\) \{\s*$'))"""


def dealt(frame: DataFrame, path: str, n: int) -> DataFrame:
    """Rows dealt by their file's name, which is added as ``path``, to ``n`` partitions."""
    return frame.repartition(n, F.expr(path)).withColumn("path", F.expr(path))


def numbered(items: DataFrame, order: list[str], heads: Column, lines: Column) -> DataFrame:
    """(path, line, text) of ``dealt`` items: a unit ``o`` has its heads, its items' lines and a closing brace.

    Items are numbered before their lines are written, so no text is moved.
    """
    w = Window.partitionBy("path").orderBy("o", *order)
    edge = lambda row: row.isNull() | ~row["o"].eqNullSafe(F.col("o"))
    marked = items.select("*", edge(F.lag(F.struct("o")).over(w)).alias("opens"), edge(F.lead(F.struct("o")).over(w)).alias("closes"), F.coalesce(lines, F.array().cast("array<string>")).alias("own"))
    n = F.size("own") + F.when(F.col("opens"), F.size(heads)).otherwise(0) + F.col("closes").cast("int")
    placed = marked.withColumn("before", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n)
    none = F.array().cast("array<string>")
    every = F.concat(F.when(F.col("opens"), heads).otherwise(none), F.col("own"), F.when(F.col("closes"), F.array(F.lit("}"))).otherwise(none))
    rows = placed.select("path", "before", F.posexplode(every).alias("at", "text"))
    return rows.select("path", (F.col("before") + F.col("at") + 1).cast("int").alias("line"), "text")


def interleaved(items: DataFrame, heads: Column, lines: Column) -> DataFrame:
    """The same for items (o, j) that need not differ: the lines of equal ones take turns."""
    w = Window.partitionBy("path").orderBy("o", "j")
    edge = lambda row: row.isNull() | ~row["o"].eqNullSafe(F.col("o"))
    at = lambda j, texts: F.transform(texts, lambda t, k: F.struct(j.cast("long").alias("j"), k.alias("k"), t.alias("text")))
    none = F.array().cast("array<string>")
    marked = items.select("path", "o", "j", edge(F.lag(F.struct("o")).over(w)).alias("opens"), edge(F.lead(F.struct("o")).over(w)).alias("closes"), F.coalesce(lines, none).alias("own"))
    every = F.concat(at(F.lit(0), F.when(F.col("opens"), heads).otherwise(none)), at(F.col("j"), F.col("own")), at(F.lit(1000000), F.when(F.col("closes"), F.array(F.lit("}"))).otherwise(none)))
    rows = marked.select("path", "o", F.inline(every))
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("o", "j", "k")).alias("line"), "text")


def _code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the line items; only their columns are shuffled."""
    def of(template: str) -> Column:
        return F.expr(" || ".join(_pieces(template)))

    blocks = F.lit(None)
    for flag, lines in BLOCKS.items():
        blocks = F.when(F.col("l_returnflag") == flag, F.array(*map(of, lines))).otherwise(blocks)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_orderkey", *order, "l_returnflag")
    return numbered(dealt(li, _PATH, text_buckets(spark, sf_dir)), order, F.array(*map(F.expr, _HEADS)), blocks)


def text_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the text and of what is found in it."""
    return buckets(spark, sf_dir, "lineitem")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text, function) of all lines: the text, scanned where it is written, stored once by path in line order."""
    return bucket_table(spark, sf_dir, "code_scanned", lambda: code.enclosing_function(_code_lines(spark, sf_dir)), "path", n=text_buckets(spark, sf_dir))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text) of the generated source."""
    return scanned(spark, sf_dir).select("path", "line", "text")


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, function, text) of the lines within functions, with their comments.

    A file's functions are looked up, so that its text is neither moved nor sorted.
    """
    return code.within(scanned(spark, sf_dir), functions(spark, sf_dir)).select("path", "line", "function", "text")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, function, text) of the lines within functions, comments cut."""
    return code.without_comments(inside(spark, sf_dir))


def code_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text index of the code lines, built once."""
    return lookup_table(spark, sf_dir, "code_trigrams", lambda: gramindex.build(code_lines(spark, sf_dir)), "gram", "part", deal=False)


def _stored(name: str, build, *sort: str):
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bucket_table(spark, sf_dir, f"code_{name}", lambda: build(spark, sf_dir), "path", *sort, n=text_buckets(spark, sf_dir))

    get.__doc__ = build.__doc__
    return get


functions = _stored("functions", lambda spark, d: code.functions(scanned(spark, d)), "path", "line_start")
calls = _stored("calls", lambda spark, d: code.calls(bodies(spark, d)))
writes = _stored("writes", lambda spark, d: code.writes(bodies(spark, d)))
blocks = _stored("blocks", lambda spark, d: code.blocks(code_lines(spark, d)))
guards = _stored("guards", lambda spark, d: code.guards(blocks(spark, d)))


#: Symbols and edges between them for the oracles.
SYM_SQL = CODE_SQL + r""",
macro AS (SELECT path, line, regexp_extract(text, '^#define (\w+) ?(.*)$', 1) AS name, regexp_extract(text, '^#define (\w+) ?(.*)$', 2) AS value FROM code WHERE starts_with(text, '#define')),
wsym AS (SELECT *, regexp_replace(lhs, '^this->', '') AS symbol FROM wr),
field AS (SELECT symbol, path, line FROM (SELECT symbol, path, line, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS r FROM wsym) WHERE r = 1),
sym AS (SELECT 'FUNCTION:' || function || '@' || path AS id, 'FUNCTION' AS kind, function AS name, path AS file, line_start, line_end FROM fn
  UNION ALL SELECT 'MACRO:' || name || '@' || path, 'MACRO', name, path, line, line FROM macro UNION ALL SELECT 'FIELD:' || symbol, 'FIELD', symbol, path, line, line FROM field),
bind AS (SELECT leaf, min(id) AS id FROM (SELECT regexp_extract(name, '\w+$') AS leaf, id FROM sym WHERE kind = 'FUNCTION') GROUP BY leaf HAVING count(DISTINCT id) = 1),
site2 AS (SELECT 'CALLS' AS kind, 'FUNCTION:' || c.function || '@' || c.path AS src, b.id AS dst, c.path, c.line FROM call c JOIN bind b ON b.leaf = c.callee
  UNION ALL SELECT 'WRITES', 'FUNCTION:' || function || '@' || path, 'FIELD:' || symbol, path, line FROM wsym
  UNION ALL SELECT 'READS', 'FUNCTION:' || u.function || '@' || u.path, 'FIELD:' || u.name, u.path, u.line FROM (SELECT path, line, function, unnest(regexp_extract_all(rhs, '[A-Za-z_]\w*')) AS name FROM wr) u JOIN field ON field.symbol = u.name),
sedge AS (SELECT kind, src, dst, count(DISTINCT (path, line))::BIGINT AS n_sites, min(line)::INT AS first_line FROM site2 GROUP BY kind, src, dst)"""


def function_id() -> Column:
    return F.concat(F.lit("FUNCTION:"), F.col("function"), F.lit("@"), F.col("path"))


def _macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, name, value) of object macros."""
    pattern = r"^#define (\w+) ?(.*)$"
    hit = code_lines(spark, sf_dir).where(F.col("text").startswith("#define"))
    return hit.select("path", "line", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("value"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, path, line) of names written to, at their first write."""
    places = writes(spark, sf_dir).groupBy(plain_symbol(F.col("lhs")).alias("symbol")).agg(F.min(F.struct("path", "line")).alias("at"))
    return places.select("symbol", "at.path", "at.line")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file, line_start, line_end): functions, macros, and names written to at their first write."""
    of = lambda frame, id_, kind, name, a, b: frame.select(id_.alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("path").alias("file"), F.col(a).alias("line_start"), F.col(b).alias("line_end"))
    parts = [
        of(functions(spark, sf_dir), function_id(), "FUNCTION", "function", "line_start", "line_end"),
        of(macros(spark, sf_dir), F.concat(F.lit("MACRO:"), "name", F.lit("@"), "path"), "MACRO", "name", "line", "line"),
        of(fields(spark, sf_dir), F.concat(F.lit("FIELD:"), "symbol"), "FIELD", "symbol", "line", "line"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(callee, dst) of last parts that one function alone has."""
    return merge.unique_or_nothing(functions(spark, sf_dir).select(leaf(F.col("function")).alias("callee"), function_id().alias("dst")), "callee", "dst")


def _meant(spark: SparkSession, sf_dir: str, called: DataFrame) -> DataFrame:
    """Rows of ``called`` whose callee is bound, with ``dst``.

    Names that are called more than ``OFTEN`` times and bound to nothing are left out before calls are dealt by name.
    """
    known = bound(spark, sf_dir)
    often = calls(spark, sf_dir).groupBy("callee").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN).select("callee").join(known, "callee", "left_anti")
    return called.join(F.broadcast(often), "callee", "left_anti").join(known, "callee")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, function, line, name) of writes."""
    return writes(spark, sf_dir).select("path", "function", "line", plain_symbol(F.col("lhs")).alias("name"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, function, line, name) of names in what is written; of a line each once if it is one write."""
    return writes(spark, sf_dir).select("path", "function", "line", F.explode(F.array_distinct(identifiers(F.col("rhs")))).alias("name"))


def _known(spark: SparkSession, sf_dir: str, named: DataFrame) -> DataFrame:
    """Rows of ``named`` whose name is written somewhere."""
    return named.join(fields(spark, sf_dir).select(F.col("symbol").alias("name")), "name")


def _symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst, path, line): calls bound where a leaf names one function, writes, and reads of written names."""
    used = writes(spark, sf_dir).select("path", "function", "line", F.explode(identifiers(F.col("rhs"))).alias("name"))
    field, parts = F.concat(F.lit("FIELD:"), "name").alias("dst"), {"WRITES": _written(spark, sf_dir), "READS": _known(spark, sf_dir, used)}
    found = [_meant(spark, sf_dir, calls(spark, sf_dir)).select(F.lit("CALLS").alias("kind"), function_id().alias("src"), "dst", "path", "line")]
    return reduce(DataFrame.unionByName, found + [part.select(F.lit(kind).alias("kind"), function_id().alias("src"), field, "path", "line") for kind, part in parts.items()])


def _counted(sites: DataFrame, name: str) -> DataFrame:
    """Sites by function and name: all are in the function's file, so they are counted where they lie."""
    return sites.groupBy("path", "function", name).agg(F.count_distinct("line").alias("n_sites"), F.min("line").alias("first_line"))


def _edges_of(counted: DataFrame, dst: Column) -> DataFrame:
    return counted.select(function_id().alias("src"), dst.alias("dst"), "n_sites", "first_line")


def _call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n_sites, first_line) of calls; they are counted before they are dealt by name."""
    return _edges_of(_meant(spark, sf_dir, _counted(calls(spark, sf_dir), "callee")), F.col("dst"))


def _write_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n_sites, first_line) of writes."""
    return _edges_of(_counted(_written(spark, sf_dir), "name"), F.concat(F.lit("FIELD:"), "name"))


def _read_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n_sites, first_line) of reads of written names."""
    return _edges_of(_counted(_known(spark, sf_dir, _read(spark, sf_dir)), "name"), F.concat(F.lit("FIELD:"), "name"))


def _kept(name: str, build, sort: str):
    """Built where their parts lie: dealing these by the column they are sorted by would move every row once more."""
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lookup_table(spark, sf_dir, f"code_{name}", lambda: build(spark, sf_dir), sort, deal=False)

    get.__doc__ = build.__doc__
    return get


macros = _stored("macros", _macros)
fields = _kept("fields", _fields, "symbol")
symbols = _kept("symbols", _symbols, "id")
symbol_sites = _kept("symbol_sites", _symbol_sites, "src")
call_edges = _kept("call_edges", _call_edges, "src")
write_edges = _kept("write_edges", _write_edges, "src")
read_edges = _kept("read_edges", _read_edges, "src")


def data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst, n_sites, first_line) of writes and reads."""
    of = lambda kind, edges: edges(spark, sf_dir).select(F.lit(kind).alias("kind"), "src", "dst", "n_sites", "first_line")
    return of("WRITES", write_edges).unionByName(of("READS", read_edges))


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst, n_sites, first_line): one row per edge, whatever its number of sites."""
    own = call_edges(spark, sf_dir).select(F.lit("CALLS").alias("kind"), "src", "dst", "n_sites", "first_line")
    return own.unionByName(data_edges(spark, sf_dir))


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_table(spark, sf_dir, "code_bound", lambda: _bound(spark, sf_dir), "callee", "callee", n=text_buckets(spark, sf_dir))
