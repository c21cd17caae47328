"""Registered queries, fifth part: build-time rules, remaining name and field operators, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import names, predicates, source_text
from quern.operators import audit, code, intervals, lineage, merge, postings, rank, traverse
from quern.plans import encode
from quern.plans import encode_code as src
from quern.plans.catalog import query
from quern.plans.catalog_trace import sym_query
from quern.plans.encode import table

FID = "'FUNCTION:' || function || '@' || path"


def _n(frame, *by):
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _functions(spark, d):
    return src.symbols(spark, d).where("kind = 'FUNCTION'")


def _fields(spark, d):
    """The symbols of fields, from the table that holds them alone: its size shows whether it can be sent to every task."""
    line = F.col("line")
    return src.fields(spark, d).select(F.concat(F.lit("FIELD:"), "symbol").alias("id"), F.lit("FIELD").alias("kind"), F.col("symbol").alias("name"), F.col("path").alias("file"), line.alias("line_start"), line.alias("line_end"))


# -- passes ---------------------------------------------------------------------------


@sym_query("SELECT kind, src, dst, n_sites, first_line FROM sedge")
def ps2_symbol_relations(spark, d):
    """Calls, writes and reads between symbols, one row per edge."""
    return src.symbol_edges(spark, d)


@sym_query("SELECT DISTINCT 'MACRO:' || name || '@' || path AS id, name, value FROM macro")
def ps3_macro_entities(spark, d):
    return src.macros(spark, d).select(F.concat(F.lit("MACRO:"), "name", F.lit("@"), "path").alias("id"), "name", "value").distinct()


@query("SELECT p_type AS block, (count(DISTINCT p_brand) * count(DISTINCT p_size % 4) * 2)::BIGINT AS keys FROM part GROUP BY p_type", graph=False)
def ps4_key_space(spark, d):
    """The number of legal keys of each group, from the sizes of its domains; no key is built."""
    dims = table(spark, d, "part").select(F.col("p_type").alias("block"), F.explode(F.array(F.struct(F.lit("brand").alias("dim"), F.col("p_brand").alias("v")), F.struct(F.lit("size").alias("dim"), (F.col("p_size") % 4).cast("string").alias("v")))).alias("x"))
    sizes = dims.groupBy("block", "x.dim").agg(F.count_distinct("x.v").alias("n"))
    return sizes.groupBy("block").agg((F.product("n") * 2).cast("long").alias("keys"))


_USE = r"use2 AS (SELECT path, line, function, unnest(regexp_extract_all(rhs, '[A-Za-z_]\w*')) AS name FROM wr)"


@sym_query(f"+{_USE}, d AS (SELECT path, function, symbol AS name, line AS def_line FROM wsym) SELECT u.path, u.line, u.name, max(d.def_line)::INT AS def_line FROM use2 u JOIN d ON d.path = u.path AND d.function = u.function AND d.name = u.name AND d.def_line < u.line GROUP BY u.path, u.line, u.name")
def ps5_def_use(spark, d):
    """Each use of a name with its nearest definition before it in the same function."""
    w = src.writes(spark, d)
    return lineage.def_use(w.withColumn("lhs", source_text.plain_symbol(F.col("lhs"))))


@sym_query("SELECT r.src AS kernel, r.dst AS field, min(w.src) AS host FROM sedge r JOIN sedge w ON w.dst = r.dst AND w.kind = 'WRITES' AND w.src LIKE '%@op_host/%' WHERE r.kind = 'READS' AND r.src LIKE '%@op_kernel/%' GROUP BY r.src, r.dst")
def ps6_host_kernel_fields(spark, d):
    """Fields that a kernel function reads and some host function writes, with the first of those."""
    e = src.symbol_edges(spark, d)
    host = e.where((F.col("kind") == "WRITES") & F.col("src").contains("@op_host/")).groupBy("dst").agg(F.min("src").alias("host"))
    read = e.where((F.col("kind") == "READS") & F.col("src").contains("@op_kernel/")).select(F.col("src").alias("kernel"), "dst")
    return read.join(host, "dst").select("kernel", F.col("dst").alias("field"), "host")


@sym_query(r"""SELECT path, line, 'setter' AS declares, regexp_extract(callee, '^set_(\w+)$', 1) AS name FROM call WHERE starts_with(callee, 'set_') UNION ALL SELECT path, line, 'constant', name FROM macro WHERE value <> ''
UNION ALL SELECT path, line_start, 'api', regexp_extract(function, '\w+$') FROM fn""")
def ps7_source_contract(spark, d):
    """What the source declares: setters, constants and functions, with their places."""
    row = lambda f, line, kind, name: f.select("path", F.col(line).alias("line"), F.lit(kind).alias("declares"), name.alias("name"))
    setters = row(src.calls(spark, d).where(F.col("callee").startswith("set_")), "line", "setter", F.regexp_extract("callee", r"^set_(\w+)$", 1))
    constants = row(src.macros(spark, d).where("value <> ''"), "line", "constant", F.col("name"))
    return setters.unionByName(constants).unionByName(row(src.functions(spark, d), "line_start", "api", names.leaf(F.col("function"))))


@sym_query("+r AS (SELECT path, 'caller' AS role FROM call UNION ALL SELECT path, 'writer' FROM wr UNION ALL SELECT path, 'guard' FROM guard UNION ALL SELECT path, 'constant' FROM macro) SELECT path, list_sort(list(DISTINCT role)) AS contains FROM r GROUP BY path")
def ps8_file_roles(spark, d):
    """What each file contains."""
    roles = {"caller": src.calls, "writer": src.writes, "guard": src.guards, "constant": src.macros}
    rows = None
    for role, of in roles.items():
        part = of(spark, d).select("path").distinct().withColumn("role", F.lit(role))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("path").agg(F.sort_array(F.collect_set("role")).alias("contains"))


@query("""WITH m AS (SELECT o_custkey, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) | bit_or(CASE o_orderpriority WHEN '1-URGENT' THEN 8 ELSE 0 END) AS mask FROM orders GROUP BY o_custkey),
dims AS (SELECT * FROM (VALUES ('settled', 1), ('open', 2), ('both', 3), ('pending', 4), ('urgent open', 10)) t(dim, dim_mask)) SELECT o_custkey, mask::INT AS mask, dim FROM m JOIN dims ON mask & dim_mask = dim_mask""", graph=False)
def ps9_covered_dims(spark, d):
    """The dims whose bits a registration's mask holds whole; the dims are a constant list."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    bit = F.when(s == "F", 1).when(s == "O", 2).otherwise(4).bitwiseOR(F.when(p == "1-URGENT", 8).otherwise(0))
    masks = table(spark, d, "orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("mask"))
    return postings.covered(masks, "mask", {"settled": 1, "open": 2, "both": 3, "pending": 4, "urgent open": 10})


@sym_query(r"""+leaf AS (SELECT regexp_extract(name, '\w+$') AS leaf, min(id) AS id FROM sym WHERE kind = 'FIELD' GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT c.path, c.line, c.callee, leaf.id AS field FROM call c JOIN leaf ON leaf.leaf = regexp_replace(c.callee, '^(set|get)_', '') WHERE regexp_matches(c.callee, '^(set|get)_')""")
def ps10_accessors(spark, d):
    """Setter and getter calls bound to the one field of their name."""
    leaves = merge.unique_or_nothing(_fields(spark, d).select(names.leaf(F.col("name")).alias("leaf"), "id"), "leaf", "id")
    c = src.calls(spark, d).where(F.col("callee").rlike("^(set|get)_")).withColumn("leaf", F.regexp_replace("callee", "^(set|get)_", ""))
    return c.join(leaves, "leaf").select("path", "line", "callee", F.col("id").alias("field"))


_SET = r"regexp_extract(text, 'Set\((v\d+), (\d+), (Pick\(.*\))\);', {})"


@sym_query(f"SELECT path, line, position::INT AS position, formal, actual FROM (SELECT path, line, unnest([0, 1, 2]) AS position, unnest(['target', 'count', 'source']) AS formal, unnest([{_SET.format(1)}, {_SET.format(2)}, {_SET.format(3)}]) AS actual FROM clean WHERE contains(text, '.Set('))")
def ps11_positional_arguments(spark, d):
    """Arguments bound to a declaration's parameters by position."""
    formals = F.array(*map(F.lit, ("target", "count", "source")))
    body = src.bodies(spark, d).where(F.col("text").contains(".Set("))
    listed = body.select("path", "line", F.posexplode(source_text.arguments("text", F.lit("Set"))).alias("position", "actual"))
    return listed.where("position < 3").select("path", "line", "position", F.get(formals, F.col("position")).alias("formal"), "actual")


@sym_query(r"""+raw AS (SELECT path, line, unnest(regexp_extract_all(text, '\bf\d+\b')) AS name, text FROM code) SELECT path, count(*)::BIGINT AS found, count(*) FILTER (regexp_matches(regexp_replace(text, '//.*', ''), '\b' || name || '\b'))::BIGINT AS kept FROM raw GROUP BY path""")
def ps12_validated_definitions(spark, d):
    """Lexical finds of field names by file, and those that stand outside comments and strings."""
    lines = src.code_lines(spark, d).where(F.col("text").rlike(r"\bf\d+\b"))
    shown = lines.withColumn("masked", source_text.mask("text")).select("path", "masked", F.explode(F.regexp_extract_all("text", F.lit(r"\bf\d+\b"), F.lit(0))).alias("name"))
    held = F.array_contains(F.regexp_extract_all("masked", F.lit(r"\bf\d+\b"), F.lit(0)), F.col("name"))
    return shown.groupBy("path").agg(F.count(F.lit(1)).alias("found"), F.count_if(held).alias("kept"))


#: Callees that a catalogue explains, with their category.
CATALOG = {"OP_CHECK": "check", "Set": "buffer_write", "Pick": "select"}


@sym_query("+cat AS (SELECT * FROM (VALUES ('OP_CHECK', 'check'), ('Set', 'buffer_write'), ('Pick', 'select')) t(callee, category)) SELECT c.callee, CASE WHEN b.id IS NOT NULL THEN 'bound' WHEN cat.category IS NOT NULL THEN 'resolved' ELSE 'open' END AS status, count(*)::BIGINT AS n FROM call c LEFT JOIN bind b ON b.leaf = c.callee LEFT JOIN cat ON cat.callee = c.callee GROUP BY ALL")
def ps13_resolved_gaps(spark, d):
    """Callees by how they are explained: by a function, by the catalogue, or not at all."""
    bound = merge.unique_or_nothing(_functions(spark, d).select(names.leaf(F.col("name")).alias("callee"), "id"), "callee", "id")
    c = src.calls(spark, d).join(bound, "callee", "left")
    status = F.when(F.col("id").isNotNull(), "bound").when(F.col("callee").isin(*CATALOG), "resolved").otherwise("open")
    return _n(c.withColumn("status", status), "callee", "status")


@sym_query(r"""+e AS (SELECT src, dst, regexp_extract(src, '@(.*)/[^/]+$', 1) AS a, regexp_extract(dst, '@(.*)/[^/]+$', 1) AS b FROM sedge WHERE kind = 'CALLS') SELECT a AS layer, count(*)::BIGINT AS calls, count(*) FILTER (a = b)::BIGINT AS within, count(*) = count(*) FILTER (a = b) AS strict FROM e GROUP BY a""")
def ps15_closure_metrics(spark, d):
    """Per layer: bound calls, those that stay in it, and whether all do."""
    of = lambda c: F.regexp_extract(c, "@(.*)/[^/]+$", 1)
    e = src.symbol_edges(spark, d).where("kind = 'CALLS'").select(of("src").alias("layer"), of("dst").alias("other"))
    g = e.groupBy("layer").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("layer") == F.col("other")).alias("within"))
    return g.withColumn("strict", F.col("calls") == F.col("within"))


@sym_query("SELECT id, CASE WHEN file LIKE 'op_kernel/%' AND line_end > line_start THEN 'verified' ELSE 'partial' END AS status FROM sym WHERE kind = 'FUNCTION'")
def ps16_kernel_identity(spark, d):
    """Functions with a body in a kernel file are verified, others stay partial."""
    sure = F.col("file").startswith("op_kernel/") & (F.col("line_end") > F.col("line_start"))
    return _functions(spark, d).select("id", F.when(sure, "verified").otherwise("partial").alias("status"))


@sym_query(r"""+m AS (SELECT name, min(path) AS path FROM macro WHERE value <> '' GROUP BY name HAVING count(*) = 1), u AS (SELECT DISTINCT path, function, unnest(regexp_extract_all(text, '\bCAP\d+\b')) AS name FROM clean)
SELECT u.name, 'MACRO:' || u.name || '@' || m.path AS macro, 'FUNCTION:' || u.function || '@' || u.path AS function FROM u JOIN m ON m.name = u.name""")
def ps17_macro_uses(spark, d):
    """Which functions expand which macro, where its name is defined once."""
    once = src.macros(spark, d).where("value <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("at")).where("n = 1")
    used = src.bodies(spark, d).select("path", "function", F.explode(names.identifiers(F.col("text"))).alias("name")).distinct()
    hit = used.join(once, "name")
    return hit.select("name", F.concat(F.lit("MACRO:"), "name", F.lit("@"), "at").alias("macro"), src.function_id().alias("function"))


@sym_query(r"""+t AS (SELECT regexp_extract(name, '\w+$') AS leaf, list_sort(list(DISTINCT id)) AS targets FROM sym WHERE kind = 'FUNCTION' GROUP BY 1)
SELECT c.callee, CASE WHEN t.leaf IS NULL THEN 'boundary' WHEN len(targets) = 1 THEN 'bound' ELSE 'set' END AS resolution, coalesce(len(targets), 0)::INT AS targets, count(*)::BIGINT AS sites FROM call c LEFT JOIN t ON t.leaf = c.callee GROUP BY ALL""")
def ps18_call_boundaries(spark, d):
    """Every callee's targets as a set: one, several, or an explicit boundary."""
    t = _functions(spark, d).groupBy(names.leaf(F.col("name")).alias("callee")).agg(F.count_distinct("id").cast("int").alias("targets"))
    n = _n(src.calls(spark, d), "callee").withColumnRenamed("n", "sites").join(t, "callee", "left")
    resolution = F.when(F.col("targets").isNull(), "boundary").when(F.col("targets") == 1, "bound").otherwise("set")
    return n.select("callee", resolution.alias("resolution"), F.coalesce("targets", F.lit(0)).alias("targets"), "sites")


@sym_query(r"SELECT path || '#' || symbol AS field, min(regexp_extract(function, '^\w+')) AS owner FROM wsym WHERE starts_with(lhs, 'this->') GROUP BY path, symbol HAVING count(DISTINCT regexp_extract(function, '^\w+')) = 1")
def ps19_qualified_fields(spark, d):
    """Members that functions of a single owner write in a file, with that owner."""
    w = src.writes(spark, d).where(source_text.is_member(F.col("lhs")) & F.col("lhs").startswith("this->"))
    return merge.unique_or_nothing(w.select(F.concat("path", F.lit("#"), source_text.plain_symbol(F.col("lhs"))).alias("field"), F.split_part("function", F.lit("::"), F.lit(1)).alias("owner")), "field", "owner")


@sym_query(r"""SELECT w.path, w.line, w.symbol, regexp_extract(w.symbol, '\w+$') AS leaf, w.rhs, coalesce(max(g.cond), '') AS guard FROM wsym w LEFT JOIN guard g ON g.path = w.path AND w.line > g.line_start AND w.line <= g.line_end GROUP BY ALL""")
def ps20_value_sites(spark, d):
    """Every assignment by its whole and its leaf name, with the condition it runs under."""
    w = src.writes(spark, d).select("path", "line", source_text.plain_symbol(F.col("lhs")).alias("symbol"), source_text.short_symbol(F.col("lhs")).alias("leaf"), "rhs")
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    around = intervals.innermost(w.select("path", "line"), g, ["path", "line"])
    conds = around.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("depth", "cond"))).alias("x"))
    return w.join(conds, ["path", "line"], "left").select("path", "line", "symbol", "leaf", "rhs", F.coalesce(source_text.joined_guards(F.col("x.cond")), F.lit("")).alias("guard"))


@sym_query(r"SELECT path, line, function, regexp_extract(text, 'OP_CHECK\((\w+) !=', 1) AS name, 'FIELD:' || regexp_extract(text, 'OP_CHECK\((\w+) !=', 1) AS field FROM clean JOIN field ON symbol = regexp_extract(text, 'OP_CHECK\((\w+) !=', 1) WHERE contains(text, 'OP_CHECK(')".replace("SELECT path, line, function", "SELECT clean.path, clean.line, function"))
def ps21_host_checks(spark, d):
    """Validations bound to the field that they test."""
    name = F.regexp_extract("text", r"OP_CHECK\((\w+) !=", 1)
    c = src.bodies(spark, d).where(F.col("text").contains("OP_CHECK(")).withColumn("name", name)
    return c.join(_fields(spark, d).select("name", F.col("id").alias("field")), "name").select("path", "line", "function", "name", "field")


@sym_query(f"+root AS (SELECT DISTINCT {FID} AS id FROM clean WHERE contains(text, '.Set(') AND path LIKE 'op_kernel/%'), w AS (SELECT id, 0 AS hops FROM root UNION SELECT e.src, w.hops + 1 FROM w JOIN sedge e ON e.dst = w.id AND e.kind = 'CALLS' WHERE w.hops < 60), m AS (SELECT id, min(hops) AS hops FROM w GROUP BY id) SELECT sym.id, CASE WHEN hops = 0 THEN 'ROOT' WHEN hops > 0 THEN 'REACHED' ELSE 'UNREACHED' END AS root_status, hops::INT AS hops FROM sym LEFT JOIN m USING (id) WHERE kind = 'FUNCTION'", recursive=True)
def ps22_root_trace(spark, d):
    """Functions by whether a call chain leads to a kernel buffer write, and how long it is."""
    root = src.bodies(spark, d).where(F.col("text").contains(".Set(") & F.col("path").startswith("op_kernel/")).select(src.function_id().alias("id"))
    back = src.call_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hops = traverse.reach(root, back).withColumnRenamed("distance", "hops")
    status = F.when(F.col("hops") == 0, "ROOT").when(F.col("hops") > 0, "REACHED").otherwise("UNREACHED")
    return src.functions(spark, d).select(src.function_id().alias("id")).join(hops, "id", "left").select("id", status.alias("root_status"), "hops")


@sym_query(r"""+x AS (SELECT c.path, c.line, c.function, c.callee, unnest(string_split(g.cond, ' && ')) AS cond, generate_subscripts(string_split(g.cond, ' && '), 1) AS i FROM call c JOIN guard g ON g.path = c.path AND c.line > g.line_start AND c.line <= g.line_end)
SELECT path, line, callee, cond, i::INT AS part, (row_number() OVER (PARTITION BY path, function, cond ORDER BY line, callee, i) - 1)::INT AS ordinal FROM x""")
def ps23_guarded_calls(spark, d):
    """One row per call and condition part it runs under, with a running ordinal for equal conditions of a function."""
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    hit = intervals.containing(src.calls(spark, d), g).where(F.col("line") != F.col("line_start"))
    x = hit.select("path", "line", "function", "callee", F.posexplode(F.split("cond", " && ")).alias("part", "cond")).withColumn("part", F.col("part") + 1)
    w = Window.partitionBy("path", "function", "cond").orderBy("line", "callee", "part")
    return x.select("path", "line", "callee", "cond", "part", (F.row_number().over(w) - 1).alias("ordinal"))


@sym_query(r"SELECT DISTINCT symbol AS alias, rhs AS target FROM wsym WHERE regexp_matches(rhs, '^[A-Za-z_]\w*$')")
def ps24_aliases(spark, d):
    """Names assigned nothing but another name."""
    w = src.writes(spark, d).where(F.col("rhs").rlike(r"^[A-Za-z_]\w*$"))
    return w.select(source_text.plain_symbol(F.col("lhs")).alias("alias"), F.col("rhs").alias("target")).distinct()


@sym_query(r"+x AS (SELECT path, line, lhs, list_distinct(regexp_extract_all(rhs, '[A-Za-z_]\w*')) AS ids FROM wr WHERE contains(rhs, '&&') OR contains(rhs, '||')) SELECT path, line, lhs AS flag, unnest(ids) AS ident FROM x WHERE len(ids) >= 2")
def ps25_derived_flags(spark, d):
    """Flags assigned from a condition over two names or more, with each of these."""
    w = src.writes(spark, d).where(F.col("rhs").contains("&&") | F.col("rhs").contains("||")).withColumn("ids", F.array_distinct(names.identifiers(F.col("rhs"))))
    return w.where(F.size("ids") >= 2).select("path", "line", F.col("lhs").alias("flag"), F.explode("ids").alias("ident"))


@sym_query(r"""SELECT path, line, function, regexp_extract(text, '^\s*(\w+) \+= (\w+)\(', 1) AS target, regexp_extract(text, '^\s*(\w+) \+= (\w+)\(', 2) AS amount, (row_number() OVER (PARTITION BY path, function, regexp_extract(text, '^\s*(\w+) \+= (\w+)\(', 1) ORDER BY line))::INT AS step FROM clean WHERE regexp_matches(text, '^\s*(\w+) \+= (\w+)\(')""")
def ps26_accumulated_sizes(spark, d):
    """Amounts added to a running total, in the order they are added."""
    pattern = r"^\s*(\w+) \+= (\w+)\("
    hit = src.bodies(spark, d).where(F.col("text").rlike(pattern)).select("path", "line", "function", F.regexp_extract("text", pattern, 1).alias("target"), F.regexp_extract("text", pattern, 2).alias("amount"))
    return hit.withColumn("step", F.row_number().over(Window.partitionBy("path", "function", "target").orderBy("line")))


@sym_query(r"""SELECT path, line, CASE WHEN contains(text, 'OP_CHECK(') THEN 'check' WHEN regexp_matches(text, '^\s*(for|while)\b') THEN 'loop' WHEN regexp_matches(text, '^\s*(if|switch)\b') THEN 'control' WHEN regexp_matches(text, '\.Set\(|\bset_\w+\(|this->') THEN 'store' WHEN regexp_matches(text, '\w \+?= ') THEN 'compute' ELSE 'other' END AS role FROM clean""")
def ps27_statement_roles(spark, d):
    t = F.col("text")
    role = F.when(t.contains("OP_CHECK("), "check").when(t.rlike(r"^\s*(for|while)\b"), "loop").when(t.rlike(r"^\s*(if|switch)\b"), "control").when(t.rlike(r"\.Set\(|\bset_\w+\(|this->"), "store").when(t.rlike(r"\w \+?= "), "compute").otherwise("other")
    return src.bodies(spark, d).select("path", "line", role.alias("role"))


@sym_query("SELECT path, line, function, text, count(*) FILTER (contains(text, ', return)')) OVER (PARTITION BY path, function ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS bailouts, (contains(text, ', return)')) AS bails FROM clean".replace("function, text, count", "function, count"))
def ps28_entry_paths(spark, d):
    """Per line, how many bail-outs of its function must have let it pass."""
    bails = F.col("text").contains(", return)")
    w = Window.partitionBy("path", "function").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return src.bodies(spark, d).select("path", "line", "function", F.coalesce(F.count_if(bails).over(w), F.lit(0)).alias("bailouts"), bails.alias("bails"))


@sym_query(r"""SELECT path, line_start, ['AND', 'GT', 'NOT', 'OR', 'EQ', 'LT'] AS operators, list_sort(list_distinct(regexp_extract_all(cond, '\b\d+\b'))) AS literals, list_sort(list_distinct(regexp_extract_all(cond, '[a-z]+\d+'))) AS "references" FROM guard""")
def ps29_predicate_columns(spark, d):
    """Conditions parsed once and kept as arrays of operators, literals and references."""
    parsed = src.guards(spark, d).select("path", "line_start", predicates.parse_predicate("cond").alias("p"))
    return parsed.select("path", "line_start", "p.operators", F.sort_array("p.literals").alias("literals"), F.sort_array("p.references").alias("references"))


@sym_query("SELECT DISTINCT regexp_extract(path, '^[^/]+') AS side, symbol AS seed, 'write' AS transport FROM wsym UNION SELECT DISTINCT regexp_extract(path, '^[^/]+'), regexp_replace(callee, '^set_', ''), 'setter' FROM call WHERE starts_with(callee, 'set_')")
def ps30_contract_seeds(spark, d):
    """One contract per side, field and way of transport."""
    side = F.split_part("path", F.lit("/"), F.lit(1)).alias("side")
    w = src.writes(spark, d).select(side, source_text.plain_symbol(F.col("lhs")).alias("seed"), F.lit("write").alias("transport"))
    s = src.calls(spark, d).where(F.col("callee").startswith("set_")).select(side, F.regexp_replace("callee", "^set_", "").alias("seed"), F.lit("setter").alias("transport"))
    return w.unionByName(s).distinct()


@sym_query("SELECT path, category, count(*)::BIGINT AS n FROM call JOIN (SELECT * FROM (VALUES ('OP_CHECK', 'check'), ('Set', 'buffer_write'), ('Pick', 'select')) t(callee, category)) USING (callee) GROUP BY ALL")
def ps31_catalog_operations(spark, d):
    """Calls that the catalogue knows, by file and category."""
    category = F.element_at(F.create_map(*(F.lit(x) for pair in CATALOG.items() for x in pair)), F.col("callee"))
    return _n(src.calls(spark, d).where(F.col("callee").isin(*CATALOG)).withColumn("category", category), "path", "category")


@sym_query(r"SELECT owner, min(path) AS path FROM (SELECT regexp_extract(function, '^\w+') || '/' || regexp_extract(path, '[^/]+$') AS owner, path FROM fn) GROUP BY owner HAVING count(DISTINCT path) = 1")
def ps32_type_bindings(spark, d):
    """Types that are defined in one file, by short name and file name."""
    owner = F.concat(F.split_part("function", F.lit("::"), F.lit(1)), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    return merge.unique_or_nothing(src.functions(spark, d).select(owner.alias("owner"), "path"), "owner", "path")


@sym_query(r"""+l AS (SELECT path, line, unnest(regexp_extract_all(text, '([A-Za-z_]\w*)\(', 1)) AS callee, 1 AS prio FROM body UNION ALL SELECT path, line, callee, 0 FROM call)
SELECT path, line, callee, CASE min(prio) WHEN 0 THEN 'walk' ELSE 'lexical' END AS source FROM l WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'return') GROUP BY path, line, callee""")
def ps33_merged_call_sites(spark, d):
    """Call sites of two scanners without repeats; where both have one, the walk's stays."""
    lexical = code.calls(src.inside(spark, d)).select("path", "line", "callee", F.lit(1).alias("prio"))
    walk = src.calls(spark, d).select("path", "line", "callee", F.lit(0).alias("prio"))
    best = walk.unionByName(lexical).groupBy("path", "line", "callee").agg(F.min("prio").alias("p"))
    return best.select("path", "line", "callee", F.when(F.col("p") == 0, "walk").otherwise("lexical").alias("source"))


@sym_query(r"""SELECT c.path, c.line, 'n' || regexp_extract(c.callee, '\d+$') AS formal, regexp_extract(clean.text, c.callee || '\((\w+), false\)', 1) AS actual FROM call c JOIN bind b ON b.leaf = c.callee JOIN clean ON clean.path = c.path AND clean.line = c.line
UNION ALL SELECT c.path, c.line, 'fast', 'false' FROM call c JOIN bind b ON b.leaf = c.callee""")
def exp3_parameter_bindings(spark, d):
    """Actual arguments of bound calls with the parameters of the function they reach, by position."""
    heads = src.code_lines(spark, d).where(F.col("text").rlike(code.DEFINITION)).select(names.leaf(F.regexp_extract("text", code.DEFINITION, 1)).alias("callee"), F.split(F.regexp_extract("text", r"\((.*)\)", 1), ", ").alias("formals"))
    once = heads.groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.first("formals").alias("formals")).where("n = 1")
    sites = src.calls(spark, d).join(once, "callee").join(src.bodies(spark, d).select("path", "line", "text"), ["path", "line"])
    args = sites.select("path", "line", "formals", F.posexplode(source_text.arguments("text", "callee")).alias("i", "actual"))
    return args.select("path", "line", F.element_at(F.split(F.get("formals", F.col("i")), " "), -1).alias("formal"), "actual")


# -- remaining operators --------------------------------------------------------------


@query("SELECT DISTINCT o_orderpriority AS variant, substr(sha256(o_orderpriority || '|' || o_orderstatus), 1, 16) AS context FROM orders", graph=False)
def rm4_build_contexts(spark, d):
    context = F.substring(F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256), 1, 16)
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("variant"), context.alias("context")).distinct()


@sym_query(r"""+n AS (SELECT DISTINCT regexp_replace(callee, '^(set_|Get)', '') AS name FROM call WHERE regexp_matches(callee, '^(set_|Get)')), known AS (SELECT regexp_extract(name, '\w+$') AS name, min(id) AS id FROM sym WHERE kind = 'FIELD' GROUP BY 1)
SELECT n.name, coalesce(known.id, 'FIELD:' || n.name) AS id, known.id IS NULL AS minted FROM n LEFT JOIN known USING (name)""")
def rm5_found_or_minted(spark, d):
    """Accessed names with the declaration that has their leaf, or a new id."""
    asked = src.calls(spark, d).where(F.col("callee").rlike("^(set_|Get)")).select(F.regexp_replace("callee", "^(set_|Get)", "").alias("name")).distinct()
    known = _fields(spark, d).groupBy(names.leaf(F.col("name")).alias("name")).agg(F.min("id").alias("id"))
    return asked.join(known, "name", "left").select("name", F.coalesce("id", F.concat(F.lit("FIELD:"), "name")).alias("id"), F.col("id").isNull().alias("minted"))


@query("""+cand AS (SELECT kind, src, dst FROM rel WHERE kind = 'BINDS' UNION SELECT 'BINDS', 'PART:' || p_partkey, 'SUPPLIER:0' FROM part WHERE p_size > 45)
SELECT c.kind, c.src, c.dst, coalesce(r.trust, 'advisory') AS trust FROM cand c LEFT JOIN rel r USING (kind, src, dst)""")
def rm6_candidates_never_weaken(spark, d):
    """Lexical candidates merged into the edges: new ones are advisory, existing ones keep their trust."""
    r = encode.relations(spark, d).where("kind = 'BINDS'").select("kind", "src", "dst", "trust")
    new = table(spark, d, "part").where("p_size > 45").select(F.lit("BINDS").alias("kind"), encode.node("PART", "p_partkey").alias("src"), F.lit("SUPPLIER:0").alias("dst"))
    return merge.with_candidates(r, r.select("kind", "src", "dst").unionByName(new))


@sym_query(f"""SELECT 'WRITES' AS kind, {FID} AS src, 'FIELD:' || symbol AS dst, path || ':' || line AS site FROM wsym UNION ALL SELECT 'GUARDED_BY', 'FIELD:' || w.symbol, g.cond, w.path || ':' || w.line FROM wsym w JOIN guard g ON g.path = w.path AND w.line > g.line_start AND w.line <= g.line_end""")
def rm7_guarded_writes(spark, d):
    """Writes as edges, and an edge from what is written to each condition around the site."""
    site = F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("site")
    w = src.writes(spark, d).withColumn("field", F.concat(F.lit("FIELD:"), source_text.plain_symbol(F.col("lhs"))))
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    guarded = intervals.containing(w.select("path", "line", "field"), g).where(F.col("line") != F.col("line_start"))
    written = w.select(F.lit("WRITES").alias("kind"), src.function_id().alias("src"), F.col("field").alias("dst"), site)
    return written.unionByName(guarded.select(F.lit("GUARDED_BY").alias("kind"), F.col("field").alias("src"), F.col("cond").alias("dst"), site))


@sym_query("""+q AS (SELECT * FROM (VALUES ('op_host/m0.cpp', 5, 9), ('m1.cpp', 5, 9), ('none.cpp', 1, 9)) t(wanted, lo, hi)), p AS (SELECT DISTINCT path FROM code),
m AS (SELECT wanted, lo, hi, path FROM q JOIN p ON path = wanted OR (ends_with(path, '/' || wanted) AND wanted NOT IN (SELECT path FROM p))) SELECT m.wanted, f.path, f.function FROM m JOIN fn f ON f.path = m.path AND f.line_start <= hi AND f.line_end >= lo""")
def rm8_range_seeds(spark, d):
    """Functions that overlap a range of a file, named in full or by its tail."""
    asked = spark.createDataFrame([("op_host/m0.cpp", 5, 9), ("m1.cpp", 5, 9), ("none.cpp", 1, 9)], "wanted string, lo int, hi int")
    files = src.code_lines(spark, d).select("path").distinct()
    met = intervals.match_files(asked.select("wanted"), files).join(asked, "wanted").select("wanted", "path", "lo", "hi")
    return src.functions(spark, d).join(met, "path").where("line_start <= hi AND line_end >= lo").select("wanted", "path", "function")


@sym_query(r"SELECT regexp_extract(symbol, '\w+$') AS name, count(*)::BIGINT AS writes, count(DISTINCT function)::BIGINT AS functions, min(path || ':' || line) AS first FROM wsym GROUP BY 1")
def rm10_writes_by_name(spark, d):
    w = src.writes(spark, d).withColumn("name", source_text.short_symbol(F.col("lhs")))
    return w.groupBy("name").agg(F.count(F.lit(1)).alias("writes"), F.count_distinct("function").alias("functions"), F.min(F.concat("path", F.lit(":"), F.col("line").cast("string"))).alias("first"))


@sym_query(rf"""+s AS (SELECT path, line, {_SET.format(1)} AS target, {_SET.format(3)} AS size FROM clean WHERE contains(text, '.Set('))
SELECT target, path, line, size, (row_number() OVER (PARTITION BY target ORDER BY path, line))::INT AS position FROM s""")
def rm11_allocation_index(spark, d):
    """Buffer calls by the leaf of their first argument; the size is the last argument where there are several."""
    args = src.bodies(spark, d).where(F.col("text").contains(".Set(")).select("path", "line", source_text.arguments("text", F.lit("Set")).alias("a"))
    got = args.select(names.leaf(F.get("a", F.lit(0))).alias("target"), "path", "line", F.when(F.size("a") > 1, F.element_at("a", -1)).alias("size"))
    return rank.positions(got, ["target"], ["path", "line"])


@sym_query(r"""SELECT f.path, f.function, CASE WHEN starts_with(c.text, 'template') THEN list_transform(string_split(regexp_extract(c.text, '<(.*)>', 1), ', '), lambda p: regexp_extract(p, '\w+$')) END AS params FROM fn f JOIN code c ON c.path = f.path AND c.line = f.line_start - 1""")
def rm12_template_parameters(spark, d):
    """Template parameters of each definition, from the header right before it."""
    head = src.code_lines(spark, d).select("path", (F.col("line") + 1).alias("line_start"), "text")
    f = src.functions(spark, d).join(head, ["path", "line_start"])
    params = F.transform(F.split(F.regexp_extract("text", "<(.*)>", 1), ", "), lambda p: F.regexp_extract(p, r"\w+$", 0))
    return f.select("path", "function", F.when(F.col("text").startswith("template"), params).alias("params"))


@sym_query(r"""+x AS (SELECT f.path, f.function, regexp_extract(w.symbol, '\w+$') AS leaf, CASE WHEN w.line = f.line_start + 3 THEN 0 ELSE 2 END AS tier, abs(w.line - f.line_start - 3) AS distance FROM fn f JOIN wsym w ON w.path = f.path AND w.function = f.function)
SELECT path, function, leaf, (min((tier, distance)))[1]::INT AS tier, (min((tier, distance)))[2]::INT AS distance FROM x GROUP BY path, function, leaf""")
def rm13_field_relevance(spark, d):
    """How near each field of a function is to its third line: written there, or by distance."""
    at = F.col("line_start") + 3
    x = src.writes(spark, d).join(src.functions(spark, d), ["path", "function"])
    best = F.min(F.struct(F.when(F.col("line") == at, 0).otherwise(2).alias("tier"), F.abs(F.col("line") - at).alias("distance")))
    return x.groupBy("path", "function", source_text.short_symbol(F.col("lhs")).alias("leaf")).agg(best.alias("b")).select("path", "function", "leaf", "b.tier", "b.distance")


@sym_query("SELECT src AS id, list_sort(list(DISTINCT dst) FILTER (kind = 'WRITES')) AS written, list_sort(list(DISTINCT dst) FILTER (kind = 'READS')) AS read FROM sedge WHERE kind IN ('WRITES', 'READS') GROUP BY src")
def rm14_unit_bundles(spark, d):
    """The fields that each function writes and reads; a function's are a few."""
    listed = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("dst"))))
    g = src.symbol_edges(spark, d).where("kind IN ('WRITES', 'READS')").groupBy(F.col("src").alias("id")).agg(listed("WRITES").alias("written"), listed("READS").alias("read"))
    return g.select("id", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("written", "read")))


@sym_query(r"""+f AS (SELECT id, regexp_extract(name, '^[a-z]+') AS bucket, contains(name, '.') AS attributed FROM sym WHERE kind = 'FIELD'), b AS (SELECT *, bool_or(attributed) OVER (PARTITION BY bucket) AS has FROM f) SELECT bucket, id, attributed FROM b WHERE attributed OR NOT has""")
def rm15_field_buckets(spark, d):
    """Fields by bucket; where some of a bucket are attributed to an owner, only those."""
    f = _fields(spark, d).select("id", F.regexp_extract("name", "^[a-z]+", 0).alias("bucket"), F.col("name").contains(".").alias("attributed"))
    has = f.groupBy("bucket").agg(F.bool_or("attributed").alias("has"))
    return f.join(has, "bucket").where("attributed OR NOT has").select("bucket", "id", "attributed")


@sym_query("SELECT f.name, s.name AS consumer FROM sedge e JOIN sym f ON f.id = e.dst JOIN sym s ON s.id = e.src WHERE e.kind IN ('READS', 'CALLS') GROUP BY ALL")
def rm16_consumers_by_name(spark, d):
    s = src.symbols(spark, d)
    e = src.symbol_edges(spark, d).where("kind IN ('READS', 'CALLS')").join(s.select(F.col("id").alias("dst"), "name"), "dst")
    return e.join(s.select(F.col("id").alias("src"), F.col("name").alias("consumer")), "src").select("name", "consumer").distinct()


@sym_query("""+r AS (SELECT dst AS field, src, path, line, row_number() OVER (PARTITION BY dst, src ORDER BY path, line) AS r FROM site2 WHERE kind = 'READS' AND path LIKE 'op_kernel/%')
SELECT field, src AS consumer, r.path, r.line, coalesce((SELECT max(cond) FROM guard g WHERE g.path = r.path AND r.line > g.line_start AND r.line <= g.line_end), '') AS guard FROM r WHERE r.r = 1""")
def rm17_kernel_consumers(spark, d):
    """Kernel functions that read a field, at the first place they do, with its condition."""
    reads = src.symbol_sites(spark, d).where((F.col("kind") == "READS") & F.col("path").startswith("op_kernel/"))
    first = reads.groupBy(F.col("dst").alias("field"), F.col("src").alias("consumer")).agg(F.min(F.struct("path", "line")).alias("p")).select("field", "consumer", "p.path", "p.line")
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    cond = intervals.innermost(first.select("path", "line").distinct(), g, ["path", "line"], 1).select("path", "line", "cond")
    return first.join(cond, ["path", "line"], "left").select("field", "consumer", "path", "line", F.coalesce("cond", F.lit("")).alias("guard"))


@sym_query("SELECT regexp_replace(c.callee, '^(set_|get_|Get)', '') AS field, count(*)::BIGINT AS sites, count(DISTINCT c.function)::BIGINT AS callers, list_sort(list(DISTINCT c.path || ':' || c.line))[1:5] AS first FROM call c WHERE regexp_matches(c.callee, '^(set_|get_|Get)') GROUP BY 1")
def rm18_accessor_sites(spark, d):
    """Accessor calls by field: how many, from how many functions, and the first five."""
    c = src.calls(spark, d).where(F.col("callee").rlike("^(set_|get_|Get)")).withColumn("field", F.regexp_replace("callee", "^(set_|get_|Get)", "")).withColumn("site", F.concat("path", F.lit(":"), F.col("line").cast("string")))
    n = c.groupBy("field").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("function").alias("callers"))
    top = traverse.top_per(c.select("field", "site").distinct(), ["field"], ["site"], 5).groupBy("field").agg(F.array_sort(F.collect_list("site")).alias("first"))
    return n.join(top, "field")


@sym_query(r"""+a AS (SELECT symbol AS alias, unnest(list_distinct(regexp_extract_all(rhs, '[A-Za-z_]\w*'))) AS field FROM wsym WHERE regexp_matches(lhs, '^flag')), s AS (SELECT alias, field, count(*) AS n FROM a GROUP BY ALL)
SELECT alias, field, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, field) AS r FROM s) WHERE r = 1""")
def rm19_alias_fields(spark, d):
    """The field that each local flag most often stands for."""
    a = src.writes(spark, d).where(F.col("lhs").startswith("flag")).select(F.col("lhs").alias("alias"), F.explode(F.array_distinct(names.identifiers(F.col("rhs")))).alias("field"))
    return traverse.top_per(_n(a, "alias", "field"), ["alias"], [F.desc("n"), "field"], 1).select("alias", "field", "n")


@sym_query("SELECT f.name, count(DISTINCT e.src) FILTER (e.kind = 'WRITES')::BIGINT AS writers, count(DISTINCT e.src) FILTER (e.kind = 'READS')::BIGINT AS readers FROM sym f LEFT JOIN sedge e ON e.dst = f.id WHERE f.kind = 'FIELD' AND f.name IN ('flag1', 'total3', 'v7', 'missing') GROUP BY f.name")
def rm20_batched_impact(spark, d):
    """The impact of several names in one pass."""
    from quern.operators import cards

    asked = _fields(spark, d).where(F.col("name").isin("flag1", "total3", "v7", "missing")).select(F.col("id").alias("dst"), "name")
    return cards.field_impact(asked, src.symbol_edges(spark, d).join(F.broadcast(asked), "dst", "left_semi")).select("name", "writers", "readers")


@sym_query(r"SELECT regexp_extract(function, '^\w+') AS launch, path, function, (row_number() OVER (PARTITION BY regexp_extract(function, '^\w+'), path ORDER BY line_start))::INT AS phase FROM fn WHERE path LIKE 'op_kernel/%'")
def rm22_launch_phases(spark, d):
    """Kernel functions of each owner in the order they stand in their file."""
    f = src.functions(spark, d).where(F.col("path").startswith("op_kernel/")).withColumn("launch", F.split_part("function", F.lit("::"), F.lit(1)))
    return f.select("launch", "path", "function", F.row_number().over(Window.partitionBy("launch", "path").orderBy("line_start")).alias("phase"))


@sym_query(r"""+m AS (SELECT path, line, text, unnest(list_distinct(regexp_extract_all(text, '\b(?:flag|total)\d+\b'))) AS name FROM clean), c AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*(auto )?' || name || ' \+?=') THEN 1 WHEN regexp_matches(text, '\w\(.*\b' || name || '\b') THEN 0 ELSE 0 END AS declares FROM m)
SELECT name, path, line, CASE declares WHEN 1 THEN 'declares' ELSE 'uses' END AS site, rank FROM (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY declares, path, line))::INT AS rank FROM c) WHERE rank <= 12""")
def rm23_use_sites(spark, d):
    """Up to twelve sites of each name, statements that use it before those that set it."""
    named = src.bodies(spark, d).select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:flag|total)\d+\b"), F.lit(0)))).alias("name"))
    lhs = F.regexp_extract("text", r"^\s*(?:auto )?(\w+) \+?=", 1)
    c = named.withColumn("declares", (lhs == F.col("name")).cast("int"))
    return traverse.top_per(c, ["name"], ["declares", "path", "line"], 12).select("name", "path", "line", F.when(F.col("declares") == 1, "declares").otherwise("uses").alias("site"), "rank")


@sym_query("SELECT id, (CASE WHEN kind = 'FIELD' THEN 0 ELSE 1 END)::INT AS occupancy, (CASE kind WHEN 'FUNCTION' THEN 0 WHEN 'FIELD' THEN 1 ELSE 2 END)::INT AS priority, (CASE WHEN line_end > line_start THEN 0 ELSE 1 END)::INT AS definition, (CASE WHEN contains(name, '.') THEN 0 ELSE 1 END)::INT AS packing FROM sym")
def rm24_secondary_ranks(spark, d):
    """Order keys beneath the match: written or not, kind, body or none, packed or not."""
    kind = F.col("kind")
    flag = lambda cond, name: F.when(cond, 0).otherwise(1).alias(name)
    return src.symbols(spark, d).select("id", flag(kind == "FIELD", "occupancy"), F.when(kind == "FUNCTION", 0).when(kind == "FIELD", 1).otherwise(2).alias("priority"), flag(F.col("line_end") > F.col("line_start"), "definition"), flag(F.col("name").contains("."), "packing"))


@query("SELECT p_partkey FROM part p WHERE p_size % 2 = 0 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size % 2 = 0 AND lower(q.p_name) = lower(p.p_name))", graph=False)
def rm25_without_twins(spark, d):
    """Types found in passing give way to a declared one of the same name."""
    p = table(spark, d, "part").withColumn("low", F.lower("p_name"))
    declared, passing = p.where("p_size % 2 = 0"), p.where("p_size % 2 <> 0 OR p_size IS NULL")
    return declared.select("p_partkey").unionByName(passing.join(declared.select("low").distinct(), "low", "left_anti").select("p_partkey"))


@sym_query("SELECT src AS id, dst AS next, rank FROM (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY kind, first_line, dst))::INT AS rank FROM (SELECT src, dst, min(kind) AS kind, min(first_line) AS first_line FROM sedge GROUP BY src, dst)) WHERE rank <= 6")
def rm26_next_hops(spark, d):
    """Up to six symbols to look at next, calls first and then by line."""
    e = src.symbol_edges(spark, d).groupBy("src", "dst").agg(F.min("kind").alias("kind"), F.min("first_line").alias("first_line"))
    return traverse.top_per(e, ["src"], ["kind", "first_line", "dst"], 6).select(F.col("src").alias("id"), F.col("dst").alias("next"), "rank")


@sym_query(r"SELECT symbol AS name, arg_min(rhs, (CASE WHEN regexp_matches(rhs, '&&|\|\||\?') THEN 0 WHEN regexp_matches(rhs, '\w\(') THEN 1 WHEN regexp_matches(rhs, '^[\w.]+$') THEN 3 ELSE 2 END, path, line)) AS rhs FROM wsym GROUP BY symbol")
def rm27_focus_writes(spark, d):
    """The value that tells most of each name: a decision, then a call, then an expression, then a copy."""
    rhs = F.col("rhs")
    tells = F.when(rhs.rlike(r"&&|\|\||\?"), 0).when(rhs.rlike(r"\w\("), 1).when(rhs.rlike(r"^[\w.]+$"), 3).otherwise(2)
    return src.writes(spark, d).groupBy(source_text.plain_symbol(F.col("lhs")).alias("name")).agg(F.min_by("rhs", F.struct(tells, "path", "line")).alias("rhs"))


@query("""+n AS (SELECT DISTINCT 'has' || upper(p_type[1:1]) || lower(p_type[2:]) AS asked, 'Is' || upper(p_type[1:1]) || lower(p_type[2:]) AS known FROM part)
SELECT asked, unnest([known, 'is' || asked[4:], asked || 'Num']) AS alias, unnest([1, 2, 3])::INT AS ordinal FROM n WHERE false UNION ALL SELECT asked, known, 1 FROM n""")
def rm28_dim_aliases(spark, d):
    """Flags as they are asked for, with the first spelling under which they are stored."""
    word = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 100)))
    types = table(spark, d, "part").select(word.alias("w")).distinct()
    asked, stored = types.select(F.concat(F.lit("has"), "w").alias("asked")), types.select(F.concat(F.lit("Is"), "w").alias("alias"))
    tried = asked.select("asked", F.posexplode(source_text.dim_aliases(F.col("asked"))).alias("ordinal", "alias"))
    return tried.join(stored, "alias").groupBy("asked").agg(F.min(F.struct("ordinal", "alias")).alias("b")).select("asked", "b.alias", "b.ordinal")


@query("SELECT p_partkey, 'brand' AS dim, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part", graph=False)
def rm29_cover_patterns(spark, d):
    """Patterns such as ``brand=B, size=3`` as filters."""
    said = F.concat(F.lit("brand = "), "p_brand", F.lit(",size="), F.col("p_size").cast("string"))
    pairs = table(spark, d, "part").select("p_partkey", F.explode(F.split(said, r"\s*,\s*")).alias("x"))
    return pairs.where(F.col("x").contains("=")).select("p_partkey", F.btrim(F.split_part("x", F.lit("="), F.lit(1))).alias("dim"), F.btrim(F.split_part("x", F.lit("="), F.lit(2))).alias("value"))


@query("SELECT p_type AS block FROM part GROUP BY p_type HAVING bool_or(p_size = 7) AND bool_or(p_brand = 'Brand#11')", graph=False)
def rm30_blocks_by_domain(spark, d):
    """Blocks whose domains hold the asked value of every dim."""
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_type").alias("block")).agg(F.bool_or(F.col("p_size") == 7).alias("a"), F.bool_or(F.col("p_brand") == "Brand#11").alias("b")).where("a AND b").select("block")


@query("+k AS (SELECT DISTINCT name FROM ent WHERE kind = 'NATION'), q AS (SELECT * FROM (VALUES ('NATON_6'), ('NATION_1X'), ('XQZXQZ')) t(asked)) SELECT asked, name AS meant, rank FROM (SELECT asked, name, (row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, name), name))::INT AS rank FROM q, k WHERE levenshtein(asked, name) <= 2) WHERE rank <= 3")
def rm31_did_you_mean(spark, d):
    """Up to three legal names within two edits of each rejected one."""

    known = encode.entities(spark, d).where("kind = 'NATION'").select("name").distinct()
    return rank.meant(known, ["NATON_6", "NATION_1X", "XQZXQZ"], 2, 3)


@sym_query(r"SELECT id, CASE WHEN name = 'Op3::Run24' OR regexp_extract(name, '\w+$') = 'Run24' THEN 'symbol' ELSE 'location' END AS by FROM sym WHERE kind = 'FUNCTION' AND (regexp_extract(name, '\w+$') = 'Run24' OR (file = 'op_host/m0.cpp' AND 6 BETWEEN line_start AND line_end))")
def rm32_resolved_seeds(spark, d):
    """Seeds of a request that gives a symbol and a location."""
    f, leaf = _functions(spark, d), names.leaf(F.col("name")) == "Run24"
    at = (F.col("file") == "op_host/m0.cpp") & F.lit(6).between(F.col("line_start"), F.col("line_end"))
    return f.where(leaf | at).select("id", F.when(leaf, "symbol").otherwise("location").alias("by"))


@sym_query("SELECT s.id, coalesce(o.n, 0)::BIGINT AS out, coalesce(i.n, 0)::BIGINT AS \"in\", s.line_end - s.line_start + 1 AS lines FROM sym s LEFT JOIN (SELECT src, count(*) AS n FROM sedge GROUP BY src) o ON o.src = s.id LEFT JOIN (SELECT dst, count(*) AS n FROM sedge GROUP BY dst) i ON i.dst = s.id")
def rm33_filled_cards(spark, d):
    e = src.symbol_edges(spark, d)
    n = lambda side, name: e.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias(name))
    s = src.symbols(spark, d).join(n("src", "out"), "id", "left").join(n("dst", "in"), "id", "left")
    return s.select("id", F.coalesce("out", F.lit(0)).cast("long").alias("out"), F.coalesce("in", F.lit(0)).cast("long").alias("in"), (F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@sym_query("+w AS (SELECT e.src, e.dst, 0 AS step FROM sedge e JOIN sym s ON s.id = e.src WHERE s.name = 'Op2::Run65') SELECT DISTINCT src, dst, a.name AS from_name, b.name AS to_name, b.kind AS to_kind, b.file || ':' || b.line_start AS location FROM w JOIN sym a ON a.id = src JOIN sym b ON b.id = dst")
def rm34_named_steps(spark, d):
    """The steps from a symbol with the names, kinds and places of their ends."""
    s = src.symbols(spark, d)
    a = s.where("name = 'Op2::Run65'").select(F.col("id").alias("src"), F.col("name").alias("from_name"))
    b = s.select(F.col("id").alias("dst"), F.col("name").alias("to_name"), F.col("kind").alias("to_kind"), F.concat("file", F.lit(":"), F.col("line_start").cast("string")).alias("location"))
    return src.symbol_edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", "from_name", "to_name", "to_kind", "location").distinct()


@sym_query(r"""+c AS (SELECT function, path, symbol AS name, line, rhs, regexp_matches(rhs, '(^|\W)' || replace(symbol, '.', '\.') || '(\W|$)') AS own, regexp_matches(rhs, '^(\d+|true|false)$') AS lit FROM wsym),
g AS (SELECT path, function, name, bool_and(own) AS all_own, count(*) AS n, count(*) FILTER (NOT own) AS free FROM c GROUP BY ALL), pool AS (SELECT c.*, g.free < g.n AS dropped, g.all_own FROM c JOIN g USING (path, function, name) WHERE NOT c.own OR g.all_own),
p AS (SELECT path, function, name, count(*) FILTER (NOT lit) AS nonlit, count(DISTINCT rhs) AS different, bool_or(dropped AND NOT all_own) OR bool_or(all_own) AS lost, arg_min(rhs, line) FILTER (NOT lit) AS best, arg_min(rhs, line) AS any_ FROM pool GROUP BY ALL)
SELECT path, function, name, CASE WHEN nonlit > 0 THEN best WHEN different > 1 OR lost THEN NULL ELSE any_ END AS value FROM p""")
def rm35_primary_definitions(spark, d):
    """Of each local the one value that a reader may take, or none where literals alone are left to choose from."""
    return lineage.primary_definitions(src.writes(spark, d).select("path", "function", source_text.plain_symbol(F.col("lhs")).alias("name"), "line", "rhs"))


@sym_query("SELECT name, min(value) AS value FROM macro GROUP BY name HAVING count(DISTINCT value) = 1")
def ag24_unique_names(spark, d):
    """Names that stand for exactly one value."""
    return merge.unique_or_nothing(src.macros(spark, d), "name", "value")


@sym_query("SELECT callee, min(path || '#' || function) AS caller FROM call GROUP BY callee HAVING count(DISTINCT path || '#' || function) = 1")
def rm36_sole_callers(spark, d):
    """Names that a single function calls, with that function."""
    return merge.unique_or_nothing(src.calls(spark, d).select("callee", F.concat("path", F.lit("#"), "function").alias("caller")), "callee", "caller")


@sym_query(r"""+t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]\w*')) AS token FROM clean WHERE contains(text, 'Run1')) SELECT token, min(id) AS id, count(DISTINCT id)::BIGINT AS n FROM t JOIN sym ON kind = 'FUNCTION' AND line_end > line_start AND regexp_extract(name, '\w+$') = token GROUP BY token""")
def tx9_resolvable_symbols(spark, d):
    """Words of the hits of a search that name functions with a body."""
    words = src.bodies(spark, d).where(F.col("text").contains("Run1")).select(F.explode(names.identifiers(F.col("text"))).alias("token")).distinct()
    f = _functions(spark, d).where("line_end > line_start").select(names.leaf(F.col("name")).alias("token"), "id")
    return words.join(f, "token").groupBy("token").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))


@sym_query(r"SELECT text, min(path) AS path FROM (SELECT path, regexp_extract(text, 'OP_CHECK\((.*), return\)', 1) AS text FROM clean WHERE contains(text, 'OP_CHECK(')) GROUP BY text")
def rm37_premises(spark, d):
    """What bail-outs require, once per text, with the first file that does."""
    c = src.bodies(spark, d).where(F.col("text").contains("OP_CHECK("))
    return c.groupBy(F.regexp_extract("text", r"OP_CHECK\((.*), return\)", 1).alias("text")).agg(F.min("path").alias("path"))


@sym_query("""SELECT w.symbol AS name, w.path, w.line, w.rhs, (row_number() OVER (PARTITION BY w.symbol ORDER BY w.path, w.line))::INT AS version, coalesce(g.cond, '') AS guard FROM wsym w LEFT JOIN guard g ON g.path = w.path AND w.line > g.line_start AND w.line <= g.line_end""")
def rm38_derivation_chains(spark, d):
    """Every write of a field in order, as a version with its value and condition."""
    v = lineage.versions(src.writes(spark, d).withColumn("name", source_text.plain_symbol(F.col("lhs"))), "name", ["path", "line"])
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    cond = intervals.innermost(v.select("path", "line"), g, ["path", "line"], 1).select("path", "line", "cond")
    return v.join(cond, ["path", "line"], "left").select("name", "path", "line", "rhs", "version", F.coalesce("cond", F.lit("")).alias("guard"))


@sym_query(r"""+t AS (SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\w*'))) AS name FROM clean), r AS (SELECT field.symbol AS field, t.path, t.line, row_number() OVER (PARTITION BY field.symbol ORDER BY t.path, t.line) AS n FROM t JOIN field ON field.symbol = t.name) SELECT field, path, line FROM r WHERE n <= 40""")
def rm39_scanned_readers(spark, d):
    """The first forty lines that mention each field as a word; longer names are words of their own."""
    words = src.bodies(spark, d).select("path", "line", F.explode(F.array_distinct(names.identifiers(F.col("text")))).alias("field"))
    hit = words.join(_fields(spark, d).select(F.col("name").alias("field")), "field")
    return traverse.top_per(hit, ["field"], ["path", "line"], 40).select("field", "path", "line")


@sym_query(r"""+x AS (SELECT f.name, bool_or(e.kind = 'READS') AS read, bool_or(e.kind = 'WRITES') AS written FROM sym f LEFT JOIN sedge e ON e.dst = f.id WHERE f.kind = 'FIELD' GROUP BY f.name), g AS (SELECT DISTINCT unnest(regexp_extract_all(cond, '[A-Za-z_]\w*')) AS name FROM guard),
d AS (SELECT DISTINCT symbol AS name FROM wsym WHERE regexp_matches(rhs, '&&|\|\|'))
SELECT x.name, CASE WHEN d.name IS NOT NULL THEN 'derived' WHEN g.name IS NOT NULL AND regexp_matches(x.name, 'size|total') THEN 'boundary' WHEN g.name IS NOT NULL THEN 'control' ELSE 'payload' END AS class, coalesce(written, false) AND NOT coalesce(read, false) AS never_read FROM x LEFT JOIN g USING (name) LEFT JOIN d USING (name)""")
def rm40_field_classes(spark, d):
    """Fields as derived, boundary, control or payload, and those that nobody reads."""
    from quern.operators import cards

    impact = cards.field_impact(_fields(spark, d).select(F.col("id").alias("dst"), "name"), src.data_edges(spark, d))
    in_guard = src.guards(spark, d).select(F.explode(names.identifiers(F.col("cond"))).alias("name")).distinct().withColumn("guard", F.lit(True))
    derived = src.writes(spark, d).where(F.col("rhs").rlike(r"&&|\|\|")).select(source_text.plain_symbol(F.col("lhs")).alias("name")).distinct().withColumn("derived", F.lit(True))
    label = F.when(F.col("derived"), "derived").when(F.col("guard") & F.col("name").rlike("size|total"), "boundary").when(F.col("guard"), "control").otherwise("payload")
    return impact.join(in_guard, "name", "left").join(derived, "name", "left").select("name", label.alias("class"), ((F.col("writers") > 0) & (F.col("readers") == 0)).alias("never_read"))


@sym_query("SELECT f.path, f.function, CASE WHEN f.path LIKE 'op_kernel/%' AND bool_or(c.callee = 'Set') THEN 'store' WHEN f.path LIKE 'op_kernel/%' THEN 'kernel' WHEN bool_or(c.callee = 'OP_CHECK') THEN 'validate' ELSE 'host' END AS stage FROM fn f LEFT JOIN call c USING (path, function) GROUP BY f.path, f.function")
def rm41_stages(spark, d):
    """The stage each function belongs to, by its layer and what it calls."""
    f = src.functions(spark, d).select("path", "function").join(src.calls(spark, d).select("path", "function", "callee"), ["path", "function"], "left")
    g = f.groupBy("path", "function").agg(F.bool_or(F.col("callee") == "Set").alias("s"), F.bool_or(F.col("callee") == "OP_CHECK").alias("c"))
    kernel = F.col("path").startswith("op_kernel/")
    return g.select("path", "function", F.when(kernel & F.coalesce("s", F.lit(False)), "store").when(kernel, "kernel").when(F.coalesce("c", F.lit(False)), "validate").otherwise("host").alias("stage"))


@sym_query(r"SELECT name, count(DISTINCT cond)::BIGINT AS predicates FROM (SELECT unnest(regexp_extract_all(cond, '[A-Za-z_]\w*')) AS name, cond FROM guard) GROUP BY name")
def rm42_lifted_predicates(spark, d):
    """Names by the number of different conditions that test them."""
    g = src.guards(spark, d).select(F.explode(names.identifiers(F.col("cond"))).alias("name"), "cond")
    return g.groupBy("name").agg(F.count_distinct("cond").alias("predicates"))


@sym_query("""+gap AS (SELECT DISTINCT callee FROM call WHERE callee NOT IN (SELECT leaf FROM bind)), res AS (SELECT * FROM (VALUES ('Pick', 'library', 'confirmed'), ('Set', 'library', 'guess')) t(callee, answer, status)) SELECT gap.callee, coalesce(res.answer, '') AS answer, CASE WHEN res.callee IS NULL THEN 'open' ELSE 'advisory' END AS state FROM gap LEFT JOIN res USING (callee)""")
def rm43_gap_resolutions(spark, d):
    """Unbound callees with answers given from outside; an answer never makes a fact of them."""
    bound = merge.unique_or_nothing(_functions(spark, d).select(names.leaf(F.col("name")).alias("callee"), "id"), "callee", "id")
    gaps = src.calls(spark, d).select("callee").distinct().join(bound, "callee", "left_anti")
    given = spark.createDataFrame([("Pick", "library"), ("Set", "library")], "callee string, answer string")
    return gaps.join(F.broadcast(given), "callee", "left").select("callee", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.col("answer").isNull(), "open").otherwise("advisory").alias("state"))


@sym_query("""+b AS (SELECT CASE WHEN starts_with(callee, 'Run') THEN 'missing_body' WHEN regexp_matches(callee, '^(set_|Get)') THEN 'accessor' ELSE 'external' END AS blocker, callee FROM call WHERE callee NOT IN (SELECT leaf FROM bind))
SELECT blocker, n, (row_number() OVER (ORDER BY CASE blocker WHEN 'missing_body' THEN 0 WHEN 'accessor' THEN 1 ELSE 2 END, n DESC))::INT AS rank FROM (SELECT blocker, count(*)::BIGINT AS n FROM b GROUP BY blocker)""")
def rm44_ranked_blockers(spark, d):
    """Why calls stay unbound, in the order of the rules and then by how often."""
    bound = merge.unique_or_nothing(_functions(spark, d).select(names.leaf(F.col("name")).alias("callee"), "id"), "callee", "id")
    c = src.calls(spark, d).join(bound, "callee", "left_anti")
    order = F.when(F.col("callee").startswith("Run"), 0).when(F.col("callee").rlike("^(set_|Get)"), 1).otherwise(2)
    n = _n(c.withColumn("o", order), "o")
    label = F.element_at(F.array(F.lit("missing_body"), F.lit("accessor"), F.lit("external")), F.col("o") + 1)
    return n.select(label.alias("blocker"), "n", F.row_number().over(Window.orderBy("o", F.desc("n"))).alias("rank"))  # three rows


_FILES = "f AS (SELECT path, sha256(string_agg(text, chr(10) ORDER BY line)) AS sha FROM code GROUP BY path)"


def _file_hashes(spark, d):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return src.code_lines(spark, d).groupBy("path").agg(F.sha2(whole, 256).alias("sha"))


@sym_query(f"+{_FILES} SELECT path, sha, substr(sha256(path || '|' || sha || '|quern/2'), 1, 16) AS extract FROM f")
def rm45_extract_fingerprints(spark, d):
    """A fingerprint of each file's content, path and schema: equal ones need no new extraction."""
    return _file_hashes(spark, d).withColumn("extract", F.substring(F.sha2(F.concat_ws("|", "path", "sha", F.lit("quern/2")), 256), 1, 16))


@sym_query(f"+{_FILES} SELECT path, CASE WHEN sha[1:1] IN ('0', '1', '2', '3') THEN 'stale' ELSE 'reuse' END AS cached, CASE WHEN contains(path, '/common/') THEN 'common' WHEN starts_with(path, 'op_host/') THEN 'host' ELSE 'kernel' END AS role FROM f")
def rm46_reusable_plans(spark, d):
    """Cached file plans that may be used again: those whose fingerprint is still the file's. A quarter are made stale here."""
    now = _file_hashes(spark, d)
    cached = now.select("path", F.when(F.substring("sha", 1, 1).isin("0", "1", "2", "3"), "old").otherwise(F.col("sha")).alias("was"))
    role = F.when(F.col("path").contains("/common/"), "common").when(F.col("path").startswith("op_host/"), "host").otherwise("kernel")
    return now.join(cached, "path").select("path", F.when(F.col("was") == F.col("sha"), "reuse").otherwise("stale").alias("cached"), role.alias("role"))


@query("SELECT DISTINCT file FROM ent WHERE file NOT LIKE 'orders/%' AND file NOT LIKE 'part/%'")
def rm47_outside_locations(spark, d):
    """Files cited by entities that lie outside the product's folders."""
    inside = F.col("file").startswith("orders/") | F.col("file").startswith("part/")
    return encode.entities(spark, d).select("file").distinct().where(~inside)


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'virtual void F' || p_size || '() {}' WHEN 1 THEN 'virtual int F() = 0;' WHEN 2 THEN 'int F() override { return 0; }' WHEN 3 THEN 'void F();' ELSE 'void F() { g(); }' END AS text FROM part)
SELECT p_partkey, starts_with(text, 'virtual') AS "virtual", contains(text, 'override') AS override, regexp_matches(text, '\\{\\s*\\}|= 0;') AS empty, contains(text, '{') AND NOT regexp_matches(text, '\\{\\s*\\}|= 0;') AS has_body FROM s""", graph=False)
def rm48_declaration_flags(spark, d):
    """Virtual, override, empty and body flags of declarations."""
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat(F.lit("virtual void F"), F.col("p_size").cast("string"), F.lit("() {}"))).when(k == 1, "virtual int F() = 0;").when(k == 2, "int F() override { return 0; }").when(k == 3, "void F();").otherwise("void F() { g(); }")
    return table(spark, d, "part").select("p_partkey", *lineage.declaration_flags(said))


@query("SELECT id, regexp_replace(file, '^([^/]+)/', 'src/\\1/') AS file FROM ent")
def rm49_rebased_paths(spark, d):
    """Every stored location under a new root."""
    e = encode.entities(spark, d).withColumn("file", F.concat(F.lit("/old/root\\"), "file"))
    return e.select("id", F.concat(F.lit("src/"), F.regexp_replace(F.regexp_replace("file", r"\\", "/"), "^/old/root/", "")).alias("file"))


@query("""+q AS (SELECT unnest(['ASIA', 'nation_1', 'order#17', 'zz']) AS asked) SELECT asked, (SELECT count(*) FROM ent WHERE lower(name) = lower(asked))::BIGINT AS exact, (SELECT count(*) FROM ent WHERE contains(lower(name), lower(asked)))::BIGINT AS inexact,
CASE WHEN (SELECT count(*) FROM ent WHERE lower(name) = lower(asked)) > 0 THEN 'matched' WHEN (SELECT count(*) FROM ent WHERE contains(lower(name), lower(asked))) > 0 THEN 'inexact' ELSE 'none' END AS note FROM q""")
def rm50_match_notes(spark, d):
    """How well each asked name was met, said with the answer."""
    asked, low = ["ASIA", "nation_1", "order#17", "zz"], F.lower("name")
    e = encode.entities(spark, d).agg(*(x for i, a in enumerate(asked) for x in (F.count_if(low == a.lower()).alias(f"e{i}"), F.count_if(low.contains(a.lower())).alias(f"c{i}"))))
    rows = e.select(F.explode(F.array(*(F.struct(F.lit(a).alias("asked"), F.col(f"e{i}").alias("exact"), F.col(f"c{i}").alias("inexact")) for i, a in enumerate(asked)))).alias("x")).select("x.*")
    return rows.withColumn("note", F.when(F.col("exact") > 0, "matched").when(F.col("inexact") > 0, "inexact").otherwise("none"))


# -- audits ---------------------------------------------------------------------------


@query("SELECT r.kind, r.src, r.dst, e.id AS entity FROM rel r JOIN ent e ON e.id IN (r.src, r.dst) WHERE r.status = 'confirmed' AND r.kind = 'CALLS' AND e.kind = 'ORDER' AND e.line_start % 10 = 3".replace("JOIN ent e ON e.id IN (r.src, r.dst)", "JOIN ent e ON e.id = r.src OR e.id = r.dst"))
def au2_confirmed_on_unresolved(spark, d):
    """Confirmed edges with an end whose identity is unresolved."""
    bad = encode.entities(spark, d).where("kind = 'ORDER' AND line_start % 10 = 3").select("id")
    return audit.touching(traverse.confirmed(encode.relations(spark, d)).where("kind = 'CALLS' AND status = 'confirmed'"), bad)


@sym_query(r"+e AS (SELECT id, name FROM sym WHERE kind = 'FUNCTION' UNION ALL SELECT 'X:' || path || ':' || line, regexp_extract(text, '^\s*(\w+)', 1) FROM clean) SELECT id, name FROM e WHERE regexp_extract(name, '\w+$') IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'do', 'else')")
def au3_keyword_callables(spark, d):
    """Callables whose name is a keyword; first words of statements are offered as such here."""
    words = src.bodies(spark, d).select(F.concat(F.lit("X:"), "path", F.lit(":"), F.col("line").cast("string")).alias("id"), F.regexp_extract("text", r"^\s*(\w+)", 1).alias("name"))
    every = _functions(spark, d).select("id", "name").unionByName(words)
    return audit.keyword_callables(every)


@sym_query(r"SELECT 'TYPE_' || owner AS id, owner AS name FROM (SELECT DISTINCT regexp_extract(function, '^\w+') AS owner FROM fn)")
def au6_leaf_only_types(spark, d):
    """Types minted under their leaf name alone, next to qualified ones that pass."""
    owner = F.split_part("function", F.lit("::"), F.lit(1))
    types = src.functions(spark, d).select(owner.alias("leaf"), F.concat(F.element_at(F.split("path", "/"), 1), F.lit("::"), owner).alias("full")).distinct()
    leaf = types.select(F.concat(F.lit("TYPE_"), "leaf").alias("id"), F.col("leaf").alias("name"))
    full = types.select(F.concat(F.lit("TYPE_"), "full").alias("id"), F.col("full").alias("name"))
    return audit.leaf_only_types(leaf.unionByName(full)).distinct()


@query("SELECT k.kind, count(ent.id)::BIGINT AS n, CASE WHEN count(ent.id) = 0 THEN 'block' WHEN count(ent.id) < 10 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT unnest(['REGION', 'NATION', 'PART', 'KERNEL']) AS kind) k LEFT JOIN ent USING (kind) GROUP BY k.kind")
def au9_missing_kinds(spark, d):
    """Required kinds by how many entities they have: none blocks, few warn."""
    return audit.required_kinds(encode.entities(spark, d), ["REGION", "NATION", "PART", "KERNEL"], 10)


@query("SELECT kind, src, dst FROM rel WHERE NOT (kind = 'BINDS' AND trust = 'advisory')")
def au10_proven_selections(spark, d):
    """Edges without the direct selections that have no evidence."""
    r = encode.relations(spark, d)
    proof = F.when(F.col("trust") != "advisory", F.col("trust"))
    return audit.without_unproven(r.withColumn("evidence", proof), ["BINDS"]).select("kind", "src", "dst")


@sym_query("""+s AS (SELECT callee, count(*) AS n FROM call WHERE starts_with(callee, 'Run') GROUP BY callee), g AS (SELECT regexp_extract(dst, '(\\w+)@', 1) AS callee, sum(n_sites) AS n FROM sedge WHERE kind = 'CALLS' GROUP BY 1)
SELECT coalesce(s.callee, g.callee) AS callee, coalesce(s.n, 0)::BIGINT AS in_source, coalesce(g.n, 0)::BIGINT AS in_graph, CASE WHEN g.n IS NULL THEN 'missing' WHEN g.n < s.n THEN 'short' ELSE 'complete' END AS gap FROM s FULL JOIN g ON g.callee = s.callee""")
def au11_source_against_graph(spark, d):
    """Calls seen in the source against calls in the graph, by callee."""
    s = _n(src.calls(spark, d).where(F.col("callee").startswith("Run")), "callee").withColumnRenamed("n", "in_source")
    g = src.symbol_edges(spark, d).where("kind = 'CALLS'").groupBy(F.regexp_extract("dst", r"(\w+)@", 1).alias("callee")).agg(F.sum("n_sites").alias("in_graph"))
    both = s.join(g, "callee", "full").select("callee", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_source", "in_graph")))
    return both.withColumn("gap", F.when(F.col("in_graph") == 0, "missing").when(F.col("in_graph") < F.col("in_source"), "short").otherwise("complete"))


@query("""SELECT kind, count(*) FILTER (trust = 'authoritative')::BIGINT AS a, count(*)::BIGINT AS n, CASE WHEN count(*) FILTER (status = 'partial') > 0 THEN 'PARTIAL' WHEN count(*) FILTER (trust = 'advisory') > 0 THEN 'WEAK' ELSE 'COMPLETE' END AS label FROM rel GROUP BY kind""")
def au12_coverage_labels(spark, d):
    r = encode.relations(spark, d).groupBy("kind").agg(F.count_if(F.col("trust") == "authoritative").alias("a"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "partial").alias("p"), F.count_if(F.col("trust") == "advisory").alias("w"))
    return r.select("kind", "a", "n", F.when(F.col("p") > 0, "PARTIAL").when(F.col("w") > 0, "WEAK").otherwise("COMPLETE").alias("label"))

