"""Registered queries, third part: scans, parsers, scalars and locations over source text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import dsl, names, predicates, source_text
from quern.operators import code, gramindex, intervals, merge, postings, text, traverse
from quern.plans import encode
from quern.plans import encode_code as src
from quern.plans.catalog import query
from quern.plans.encode import table
from quern.plans.encode_code import CODE_SQL


def code_query(sql: str = ""):
    return query(sql, base=CODE_SQL)


def _one(frame, *by):
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# -- scans and parsers ----------------------------------------------------------------

_FACTS = r"""fact AS (SELECT path, line, function, 'call' AS fact, callee AS name FROM call
UNION ALL SELECT path, line, function, 'member', unnest(regexp_extract_all(text, 'this->([A-Za-z_][\w.]*)', 1)) FROM clean
UNION ALL SELECT path, line, function, 'alias', unnest(regexp_extract_all(text, 'auto ([A-Za-z_]\w*) =', 1)) FROM clean
UNION ALL SELECT path, line, function, 'buffer', unnest(regexp_extract_all(text, '\b(buf\d+)\.', 1)) FROM clean)"""


@code_query(f"+{_FACTS} SELECT path, line, function, fact, name FROM fact")
def src9_file_facts(spark, d):
    return code.facts(src.bodies(spark, d))


@code_query(f"+{_FACTS} SELECT path, fact, count(*)::BIGINT AS n FROM fact WHERE path IN ('op_host/m0.cpp', 'op_kernel/arch35/m1.cpp') GROUP BY ALL")
def src10_facts_for_files(spark, d):
    return _one(code.facts_for(code.facts(src.bodies(spark, d)), ["op_host/m0.cpp", "op_kernel/arch35/m1.cpp"]), "path", "fact")


@query("""SELECT p_brand AS tag, 'size' AS name, 'UINT' AS kind, 0::INT AS bit_lo, 7::INT AS bit_hi, list_sort(list(DISTINCT p_size::VARCHAR)) AS values FROM part GROUP BY p_brand
UNION ALL SELECT DISTINCT p_brand, 'flag', 'BOOL', 8, 8, ['0', '1'] FROM part UNION ALL SELECT p_brand, 'type', 'DTYPE', 9, 16, list_sort(list(DISTINCT 'T<' || p_type || ', 1>')) FROM part GROUP BY p_brand""", graph=False)
def src11_domain_parser(spark, d):
    part = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("string"))).alias("s"), F.sort_array(F.collect_set(F.concat(F.lit("T<"), "p_type", F.lit(", 1>")))).alias("t"))
    said = F.concat(
        F.lit("ARGS_DECL("), "p_brand", F.lit(", UINT_DECL(size, 8, "), F.array_join("s", ", "), F.lit("),\n BOOL_DECL(flag, 0, 1), DTYPE_DECL(type, "), F.array_join("t", ", "), F.lit("))")
    )
    return part.select(F.col("p_brand").alias("tag"), F.explode(dsl.parse_domains(said)).alias("x")).select("tag", "x.name", "x.kind", "x.bit_lo", "x.bit_hi", F.sort_array("x.values").alias("values"))


@query("""SELECT struct, (row_number() OVER (PARTITION BY struct ORDER BY field) - 1)::INT AS position, field, length FROM (SELECT DISTINCT replace(p_brand, '#', '') AS struct, 'size' || p_size AS field, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS length FROM part)
UNION ALL SELECT 'C' || struct, (row_number() OVER (PARTITION BY struct ORDER BY field) - 1)::INT, field, length FROM (SELECT DISTINCT replace(p_brand, '#', '') AS struct, 'size' || p_size AS field, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS length FROM part)""", graph=False)
def src12_struct_parser(spark, d):
    part = table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "").alias("s"), "p_size").distinct().withColumn("f", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    size = F.col("p_size").cast("string")
    macro = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("FIELD_ARR(int32_t, "), size, F.lit(", "), "f", F.lit(");"))).otherwise(F.concat(F.lit("FIELD(int32_t, "), "f", F.lit(");")))
    plain = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("uint64_t "), "f", F.lit("["), size, F.lit("];"))).otherwise(F.concat(F.lit("uint64_t "), "f", F.lit(" = 0;")))
    said = part.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("f", macro.alias("m"), plain.alias("p")))).alias("x"))
    whole = F.concat(F.lit("BEGIN_STRUCT("), "s", F.lit(")\n"), F.array_join("x.m", "\n"), F.lit("\nEND_STRUCT;\nclass C"), "s", F.lit(" {\n"), F.array_join("x.p", "\n"), F.lit("\n};"))
    return said.select(F.explode(dsl.parse_structs(whole)).alias("y")).select("y.struct", "y.position", "y.field", "y.length")


@query("""SELECT n_name AS op, CASE n_nationkey % 3 WHEN 0 THEN 'Input' WHEN 1 THEN 'Output' ELSE 'Attr' END AS role, 'p' || n_regionkey AS name, n_nationkey % 2 = 0 AS required, CASE WHEN n_nationkey % 3 < 2 THEN ['DT_A', 'DT_' || n_regionkey] ELSE [] END AS types FROM nation
UNION ALL SELECT n_name, 'Output', 'out', true, ['DT_B'] FROM nation""", graph=False)
def src13_operator_parser(spark, d):
    k = F.col("n_nationkey")
    role = F.when(k % 3 == 0, "Input").when(k % 3 == 1, "Output").otherwise("Attr")
    kind = F.when(k % 2 == 0, "REQUIRED").otherwise("OPTIONAL")
    region = F.col("n_regionkey").cast("string")
    types = F.when(k % 3 < 2, F.concat(F.lit(".DataType({DT_A, DT_"), region, F.lit("})"))).otherwise("")
    said = F.concat(F.lit('this->'), role, F.lit('("p'), region, F.lit('").'), F.when(role == "Attr", "AttrType(").otherwise("ParamType("), kind, F.lit(")"), types, F.lit(';\nthis->Output("out").ParamType(REQUIRED).DataType({DT_B});'))
    return table(spark, d, "nation").select(F.col("n_name").alias("op"), F.explode(dsl.parse_operator(said)).alias("x")).select("op", "x.role", "x.name", "x.required", "x.types")


@query("SELECT c_nationkey::VARCHAR AS file, c_mktsegment AS section, c_name AS key, c_custkey::VARCHAR AS value FROM customer", graph=False)
def src14_settings_reader(spark, d):
    pair = F.concat("c_name", F.lit(" = "), F.col("c_custkey").cast("string"))
    per = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.concat(F.lit("["), "c_mktsegment", F.lit("]\n; made\n"), F.array_join(F.sort_array(F.collect_list(pair)), "\n")).alias("part"))
    files = per.groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("part")), "\n\n").alias("text"))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    section = code.last_seen(F.when(F.col("text").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("text", r"\[(.*)\]", 1)))
    pairs = lines.withColumn("section", section).where(F.col("text").rlike(r"^\s*[^;#\[][^=]*="))
    return pairs.select(F.col("path").alias("file"), "section", F.btrim(F.split_part("text", F.lit("="), F.lit(1))).alias("key"), F.btrim(F.split_part("text", F.lit("="), F.lit(2))).alias("value"))


# -- filters, projections, joins ------------------------------------------------------

_MACRO = r"macro AS (SELECT path, line, regexp_extract(text, '^#define (\w+) ?(.*)$', 1) AS name, regexp_extract(text, '^#define (\w+) ?(.*)$', 2) AS value FROM code WHERE starts_with(text, '#define'))"


@code_query(f"+{_MACRO} SELECT path, line, name FROM macro WHERE NOT (regexp_matches(name, '_H_?$') AND value = '')")
def flt14_no_include_guards(spark, d):
    return src.macros(spark, d).where(~(F.col("name").rlike("_H_?$") & (F.col("value") == ""))).select("path", "line", "name")


@code_query("SELECT DISTINCT path FROM code WHERE NOT regexp_matches(path, '(^|/)arch(22|[0-24-9][0-9]|3[0-46-9])(/|$)')")
def flt15_own_architecture(spark, d):
    foreign = F.exists(F.split("path", "/"), lambda p: p.rlike(r"^arch\d+$") & (p != "arch35"))
    return src.code_lines(spark, d).select("path").distinct().where(~foreign)


@query("SELECT r.src AS id, r.kind, r.dst AS other FROM rel r WHERE NOT (r.kind = 'CONTAINS' AND r.src LIKE 'NATION:%') UNION ALL SELECT r.dst, r.kind, r.src FROM rel r WHERE r.kind <> 'CONTAINS'")
def flt16_composition_neighbors(spark, d):
    """Each node's neighbours without the inverted containment edges and the parts of a nation."""
    r = encode.relations(spark, d)
    out = r.select(F.col("src").alias("id"), "kind", F.col("dst").alias("other"), F.lit("out").alias("side"))
    into = r.select(F.col("dst").alias("id"), "kind", F.col("src").alias("other"), F.lit("in").alias("side"))
    hidden = (F.col("kind") == "CONTAINS") & ((F.col("side") == "in") | F.col("id").startswith("NATION:"))
    return out.unionByName(into).where(~hidden).select("id", "kind", "other")


@query(r"""SELECT id, regexp_matches(name, '^[A-Za-z_]\w*$') AS identifier, regexp_matches(name, '[*?]') AS glob, regexp_matches(id, '^[A-Z]+:\d+$') AS graph_id FROM ent
UNION ALL SELECT id || '*', false, true, false FROM ent""")
def flt18_recognisers(spark, d):
    e = encode.entities(spark, d)
    shown = e.select("id", "name").unionByName(e.select(F.concat("id", F.lit("*")).alias("id"), F.concat("name", F.lit("*")).alias("name")))
    return shown.select("id", F.col("name").rlike(r"^[A-Za-z_]\w*$").alias("identifier"), F.col("name").rlike("[*?]").alias("glob"), F.col("id").rlike(r"^[A-Z]+:\d+$").alias("graph_id"))


@query("""SELECT 'PART:' || p_partkey AS id, unnest(['brand', 'type', 'size']) AS fact, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part
UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT 'ORDER:' || o_orderkey, unnest(['status', 'priority']), unnest([o_orderstatus, o_orderpriority]) FROM orders""", graph=False)
def prj1_projected_facts(spark, d):
    """The facts that each kind shows, as rows; other columns of its table are left out."""
    shown = {
        "PART": ("part", "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"}), "CUSTOMER": ("customer", "c_custkey", {"segment": "c_mktsegment"}),
        "ORDER": ("orders", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"}),
    }
    out = None
    for kind, (name, key, facts) in shown.items():
        pairs = F.array(*(F.struct(F.lit(f).alias("fact"), F.col(c).cast("string").alias("value")) for f, c in facts.items()))
        rows = table(spark, d, name).select(encode.node(kind, key).alias("id"), F.explode(pairs).alias("x")).select("id", "x.fact", "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out


_CARD = r"""card AS (SELECT f.path, f.function, f.line_start, f.line_end, c.text AS snippet,
  coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_writes, 0)::BIGINT AS n_writes, coalesce(callees, []) AS callees FROM fn f JOIN code c ON c.path = f.path AND c.line = f.line_start
  LEFT JOIN (SELECT path, function, count(*) AS n_calls, list_sort(list(DISTINCT callee))[1:3] AS callees FROM call GROUP BY ALL) k ON k.path = f.path AND k.function = f.function
  LEFT JOIN (SELECT path, function, count(*) AS n_writes FROM wr GROUP BY ALL) w ON w.path = f.path AND w.function = f.function)"""


def _cards(spark, d):
    keys = ["path", "function"]
    called = src.calls(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.slice(F.sort_array(F.collect_set("callee")), 1, 3).alias("callees"))
    written = src.writes(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_writes"))
    first = src.code_lines(spark, d).select("path", F.col("line").alias("line_start"), F.col("text").alias("snippet"))
    card = src.functions(spark, d).join(first, ["path", "line_start"]).join(called, keys, "left").join(written, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return card.select(*keys, "line_start", "line_end", "snippet", zero("n_calls"), zero("n_writes"), F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


@code_query(f"+{_CARD} SELECT * FROM card")
def prj2_function_cards(spark, d):
    return _cards(spark, d)


@code_query(f"+{_CARD} SELECT path || ':' || line_start AS location, regexp_extract(function, '\\w+$') AS name, snippet, n_calls FROM card")
def prj3_agent_cards(spark, d):
    """Cards as shown: a location and a leaf name, no ids."""
    return _cards(spark, d).select(F.concat("path", F.lit(":"), F.col("line_start").cast("string")).alias("location"), names.leaf(F.col("function")).alias("name"), "snippet", "n_calls")


@code_query("""+f AS (SELECT DISTINCT path FROM code), w AS (SELECT path AS wanted FROM f UNION ALL SELECT regexp_extract(path, '[^/]+$') FROM f UNION ALL SELECT 'none/' || path FROM f)
SELECT wanted, path, CASE WHEN path = wanted THEN 'exact' ELSE 'suffix' END AS stage FROM w JOIN f ON path = wanted OR (ends_with(path, '/' || wanted) AND NOT EXISTS (SELECT 1 FROM f g WHERE g.path = wanted))""")
def jn13_file_matches(spark, d):
    """Wanted file names: equal paths first, and paths that end in the name only where none is equal."""
    files = src.code_lines(spark, d).select("path").distinct()
    wanted = files.select(F.col("path").alias("wanted")).unionByName(files.select(F.element_at(F.split("path", "/"), -1).alias("wanted"))).unionByName(files.select(F.concat(F.lit("none/"), "path").alias("wanted")))
    return intervals.match_files(wanted, files)


@query("SELECT path, line FROM line WHERE contains(lower(text), 'ering')")
def jn15_trigram_join(spark, d):
    """Lines found through postings of their trigrams, then tested."""
    return gramindex.search(encode.source_lines(spark, d), encode.line_trigrams(spark, d), "ering").select("path", "line")


# -- scalars --------------------------------------------------------------------------


@query(r"SELECT id, kind, regexp_extract(id, '^([A-Z]+):', 1) AS parsed, regexp_matches(id, '^[A-Z]+:\d+$') AS valid FROM ent UNION ALL SELECT name, kind, regexp_extract(name, '^([A-Z]+):', 1), regexp_matches(name, '^[A-Z]+:\d+$') FROM ent")
def sf5_parse_kind(spark, d):
    e = encode.entities(spark, d)
    both = e.select("id", "kind").unionByName(e.select(F.col("name").alias("id"), "kind"))
    return both.select("id", "kind", F.regexp_extract("id", "^([A-Z]+):", 1).alias("parsed"), F.col("id").rlike(r"^[A-Z]+:\d+$").alias("valid"))


@code_query(r"SELECT DISTINCT './' || replace(path, '/', '\') AS shown, path AS normal, true AS same FROM code")
def sf6_normal_paths(spark, d):
    files = src.code_lines(spark, d).select("path").distinct().withColumn("shown", F.concat(F.lit("./"), F.regexp_replace("path", "/", "\\\\")))
    normal = names.normal_path(F.col("shown"))
    return files.select("shown", normal.alias("normal"), names.same_path(F.col("shown"), F.element_at(F.split("path", "/"), -1)).alias("same"))


@query("SELECT p_partkey, '!v' || p_size AS once, '(v' || p_size || ')' AS twice, '!(a && b' || p_size || ')' AS kept, '!(!a && b)' AS kept2 FROM part", graph=False)
def sf11_simplified_negations(spark, d):
    size = F.col("p_size").cast("string")
    said = lambda *x: source_text.simplify_negation(F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x)))
    return table(spark, d, "part").select(
        "p_partkey", said("!(v", size, ")").alias("once"), said("!(!(v", size, "))").alias("twice"), said("!(a && b", size, ")").alias("kept"), said("!(!a && b)").alias("kept2"),
    )


@code_query(r"SELECT path, line, regexp_replace(lhs, '^this->', '') AS symbol, regexp_extract(lhs, '\w+$') AS short, starts_with(lhs, 'this->') AS member FROM wr")
def sf13_symbols(spark, d):
    lhs = F.col("lhs")
    return src.writes(spark, d).select("path", "line", source_text.plain_symbol(lhs).alias("symbol"), source_text.short_symbol(lhs).alias("short"), source_text.is_member(lhs).alias("member"))


@code_query("""SELECT path, line, CASE WHEN contains(text, '//') THEN text[1:strpos(text, '//') - 1] || repeat(' ', length(text) - strpos(text, '//') + 1) ELSE text END AS masked FROM code""")
def sf14_masked_lines(spark, d):
    return src.code_lines(spark, d).select("path", "line", source_text.mask("text").alias("masked"))


@code_query(r"""SELECT path, line, 'Set' AS callee, [regexp_extract(text, 'Set\((v\d+), (\d+), (Pick\(.*\))\);', 1), regexp_extract(text, 'Set\((v\d+), (\d+), (Pick\(.*\))\);', 2), regexp_extract(text, 'Set\((v\d+), (\d+), (Pick\(.*\))\);', 3)] AS args FROM clean WHERE contains(text, '.Set(')
UNION ALL SELECT path, line, 'Pick', [regexp_extract(text, 'Pick\((\w+), (\d+)\)', 1), regexp_extract(text, 'Pick\((\w+), (\d+)\)', 2)] FROM clean WHERE contains(text, 'Pick(')""")
def sf15_call_arguments(spark, d):
    found = src.calls(spark, d).where(F.col("callee").isin("Set", "Pick")).join(src.bodies(spark, d).select("path", "line", "text"), ["path", "line"])
    return found.select("path", "line", "callee", source_text.arguments("text", "callee").alias("args"))


#: Phrases and the source tokens they stand for.
LEXICON = [("validation", "OP_CHECK"), ("buffer write", ".Set("), ("accumulate", "+="), ("setter", "set_")]


@code_query("+lex AS (SELECT * FROM (VALUES ('validation', 'OP_CHECK'), ('buffer write', '.Set('), ('accumulate', '+='), ('setter', 'set_')) t(phrase, token)) SELECT phrase, path, count(*)::BIGINT AS n FROM code JOIN lex ON contains(text, token) GROUP BY ALL")
def sf16_lexicon_tags(spark, d):
    return _one(text.tagged(src.code_lines(spark, d), LEXICON), "phrase", "path")


@code_query(rf"""+{_MACRO}, v AS (SELECT name, min(value) AS value FROM macro WHERE value <> '' GROUP BY name), u AS (SELECT path, line, text, regexp_extract(text, 'CAP\d+') AS name FROM clean WHERE regexp_matches(text, 'CAP\d+'))
SELECT path, line, CASE WHEN value IS NULL THEN text ELSE replace(text, name, value) END AS text FROM u LEFT JOIN v USING (name)""")
def sf17_expanded_macros(spark, d):
    defined = src.macros(spark, d).where("value <> ''").groupBy("name").agg(F.min("value").alias("value"))
    used = src.bodies(spark, d).where(F.col("text").rlike(r"CAP\d+")).select("path", "line", "text")
    return text.expand(used, ["path", "line"], defined)


_PICK = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{' || p_size || ', -1, 1}' WHEN 1 THEN '(' || p_size || ')' WHEN 2 THEN 'x + ' || p_size ELSE '0' END AS expr FROM part"
_INTS = r"CASE WHEN regexp_matches(expr, '^[\d\s{}(),+-]+$') THEN list_sort(list_distinct(list_transform(regexp_extract_all(expr, '[+-]?\d+'), lambda x: x::BIGINT))) ELSE []::BIGINT[] END"


def _const_exprs(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    expr = F.when(k == 0, F.concat(F.lit("{"), size, F.lit(", -1, 1}"))).when(k == 1, F.concat(F.lit("("), size, F.lit(")"))).when(k == 2, F.concat(F.lit("x + "), size)).otherwise("0")
    return table(spark, d, "part").select("p_partkey", expr.alias("expr"))


@query(f"WITH e AS ({_PICK}) SELECT p_partkey, expr, {_INTS} AS ints FROM e", graph=False)
def nf3_integer_occupancy(spark, d):
    return _const_exprs(spark, d).withColumn("ints", source_text.occupancy(F.col("expr")))


@query(f"""WITH e AS (SELECT expr, min(p_partkey) AS k FROM ({_PICK}) GROUP BY expr), o AS (SELECT expr, k, {_INTS} AS ints FROM e)
SELECT a.expr AS a, b.expr AS b, list_sort(list_intersect(a.ints, b.ints)) AS common FROM o a JOIN o b ON a.k < b.k WHERE len(list_intersect(a.ints, b.ints)) > 0
AND (len(list_filter(list_intersect(a.ints, b.ints), lambda x: x NOT IN (0, 1))) > 0 OR (contains(a.expr, '{{') AND contains(b.expr, '{{')))""", graph=False)
def set7_worth_sharing(spark, d):
    """Pairs of constant expressions whose common integers tell something."""
    exprs = _const_exprs(spark, d).groupBy("expr").agg(F.min("p_partkey").alias("k")).withColumn("ints", source_text.occupancy(F.col("expr")))
    return postings.sharing(exprs, "k", "ints", "expr")


_CMP = r"cmp AS (SELECT path, line_start, regexp_extract(x, '^(\w+) (==|!=|>=|<=|>|<) (\d+)$', 1) AS field, regexp_extract(x, '^(\w+) (==|!=|>=|<=|>|<) (\d+)$', 2) AS op, regexp_extract(x, '^(\w+) (==|!=|>=|<=|>|<) (\d+)$', 3)::INT AS value FROM (SELECT path, line_start, unnest(regexp_extract_all(cond, '[A-Za-z_]\w* (?:==|!=|>=|<=|>|<) \d+')) AS x FROM guard))"


@code_query(f"+{_CMP} SELECT field, max(CASE op WHEN '<' THEN value WHEN '<=' THEN value + 1 END)::INT AS lo, min(CASE op WHEN '>' THEN value WHEN '>=' THEN value - 1 END)::INT AS hi FROM cmp WHERE op IN ('<', '<=', '>', '>=') GROUP BY field")
def nf4_bounds_of_rejections(spark, d):
    """What rejecting comparisons leave of a variable's range, taking every guard as a rejection."""
    v, op = F.col("value"), F.col("op")
    c = code.comparisons(src.guards(spark, d)).where(op.isin("<", "<=", ">", ">="))
    return c.groupBy("field").agg(F.max(F.when(op == "<", v).when(op == "<=", v + 1)).alias("lo"), F.min(F.when(op == ">", v).when(op == ">=", v - 1)).alias("hi"))


@code_query(f"+{_CMP}, two AS (SELECT field, op, value FROM cmp UNION SELECT field, CASE op WHEN '==' THEN '!=' WHEN '!=' THEN '==' WHEN '>=' THEN '<' WHEN '<' THEN '>=' WHEN '>' THEN '<=' ELSE '>' END, value FROM cmp) SELECT field, op, value FROM two")
def nf5_boundary_classes(spark, d):
    turned = F.create_map(*(F.lit(x) for x in ("==", "!=", "!=", "==", ">=", "<", "<", ">=", ">", "<=", "<=", ">")))
    c = code.comparisons(src.guards(spark, d)).select("field", "op", "value").distinct()
    return c.withColumn("op", F.explode(F.array("op", F.element_at(turned, F.col("op"))))).distinct()


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE (l_quantity::INT + l_linenumber) * 2.0 / (l_suppkey % 3) END, 6) AS value, l_quantity::INT > 10 AND l_linenumber <> 2 AS holds FROM lineitem", graph=False)
def nf6_evaluated_expressions(spark, d):
    q, s, n = F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 3).cast("string"), F.col("l_linenumber").cast("string")
    sum_ = F.concat(F.lit("("), q, F.lit(" + "), n, F.lit(") * 2 / ("), s, F.lit(")"))
    test = F.concat(q, F.lit(" > 10 && "), n, F.lit(" != 2"))
    value = lambda x: predicates.evaluate_text(x)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    return table(spark, d, "lineitem").select(*keys, F.round(value(sum_), 6).alias("value"), (value(test) == 1).alias("holds"))


@query("SELECT p_partkey, unnest(['a', 'b', 'c']) AS field, unnest([0, p_size % 7 + 1, p_size % 7 + 9])::INT AS shift FROM part UNION ALL SELECT p_partkey, unnest(['x', 'y']), unnest([0, 4])::INT FROM part", graph=False)
def nf7_packed_axes(spark, d):
    """Fields and shifts of packing expressions: a chain of shifts, and a weighted sum."""
    one, two = ((F.col("p_size") % 7 + k).cast("string") for k in (1, 9))
    chain = F.concat(F.lit("a | (b << "), one, F.lit(") | (c << "), two, F.lit(")"))
    exprs = table(spark, d, "part").select("p_partkey", F.explode(F.array(chain, F.lit("x + y * 16"))).alias("expr"))
    return exprs.select("p_partkey", F.explode(predicates.packed_axes("expr")).alias("a")).select("p_partkey", "a.field", "a.shift")


@query("""SELECT kind, src, dst, list_sort(list(DISTINCT line)) AS lines FROM site GROUP BY kind, src, dst""")
def af1_accumulated_sites(spark, d):
    """Site lists that arrive in two batches, joined per relation without repeats."""
    sites = encode.sites(spark, d)
    batch = lambda cond: sites.where(cond).groupBy("kind", "src", "dst").agg(F.collect_list("line").alias("lines"))
    both = batch("line <= 3").unionByName(batch("line > 3"))
    joined = both.groupBy("kind", "src", "dst").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    return joined.select("kind", "src", "dst", F.sort_array(F.array_distinct("lines")).alias("lines"))


@query("SELECT p_partkey AS key_id, [p_brand, p_type, (p_size % 8)::VARCHAR] AS compact, p_brand AS brand, p_type AS type, (p_size % 8)::VARCHAR AS size FROM part", graph=False)
def af4_compact_keys(spark, d):
    """Postings as positional arrays and back to named columns."""
    order = ["brand", "type", "size"]
    wide = encode.key_dims(spark, d).groupBy("key_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    compact = wide.select("key_id", F.array(*(F.element_at("m", F.lit(n)) for n in order)).alias("compact"))
    grown = F.map_from_arrays(F.array(*map(F.lit, order)), "compact")
    return compact.select("key_id", "compact", *(F.element_at(grown, F.lit(n)).alias(n) for n in order))


_PROV = """p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'ast_walk' WHEN 2 THEN 'dsl_parse' WHEN 3 THEN 'lexical_scan' WHEN 4 THEN 'heuristic_guess' WHEN 5 THEN 'late_ast_pass' ELSE 'other' END AS provenance,
CASE WHEN event_id % 11 = 0 THEN 'derived' END AS override FROM events),
i AS (SELECT *, CASE WHEN provenance = 'ast_walk' OR contains(provenance, 'ast') THEN 'ast' WHEN provenance = 'dsl_parse' THEN 'dsl' WHEN contains(provenance, 'heuristic') THEN 'heuristic' WHEN contains(provenance, 'lexical') THEN 'lexical' ELSE 'unspecified' END AS source,
CASE WHEN contains(provenance, 'ast') THEN 'authoritative' WHEN provenance = 'dsl_parse' THEN 'derived' WHEN contains(provenance, 'heuristic') OR contains(provenance, 'lexical') THEN 'advisory' ELSE 'legacy_unknown' END AS trust FROM p)"""


def _provenances(spark, d):
    k = F.col("event_id") % 7
    said = ["", "ast_walk", "dsl_parse", "lexical_scan", "heuristic_guess", "late_ast_pass"]
    prov = F.lit("other")
    for i, name in enumerate(said):
        prov = F.when(k == i, name).otherwise(prov)
    return table(spark, d, "events").select("event_id", prov.alias("provenance"), F.when(F.col("event_id") % 11 == 0, "derived").alias("override"))


@query(f"WITH {_PROV} SELECT event_id, source, trust FROM i", graph=False)
def rm2_inferred_provenance(spark, d):
    got = merge.inferred(F.col("provenance"))
    return _provenances(spark, d).select("event_id", got["source"].alias("source"), got["trust"].alias("trust"))


@query(f"WITH {_PROV} SELECT event_id, CASE WHEN override IS DISTINCT FROM trust AND override IS NOT NULL THEN override END AS stored, coalesce(override, trust) AS grown FROM i", graph=False)
def af6_shrunk_evidence(spark, d):
    """Trust is stored only where it differs from what the provenance says, and grown back when read."""
    implied = merge.inferred(F.col("provenance"))["trust"]
    full = _provenances(spark, d).withColumn("trust", F.coalesce("override", implied))
    stored = full.select("event_id", "provenance", F.when(F.col("trust") != implied, F.col("trust")).alias("stored"))
    return stored.select("event_id", "stored", F.coalesce("stored", merge.inferred(F.col("provenance"))["trust"]).alias("grown"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] ELSE text END AS text, string_split(text, ' ')[1:16] AS words FROM documents", graph=False)
def af7_trimmed_attributes(spark, d):
    """Attributes cut for storage: strings to 200 characters, lists to 16 entries."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.substring("text", 1, 200).alias("text"), F.slice(F.split("text", " ", -1), 1, 16).alias("words"))


# -- locations ------------------------------------------------------------------------


@code_query("""SELECT path, line, line_start, line_end, depth FROM (SELECT c.path, c.line, b.line_start, b.line_end, b.level AS depth, row_number() OVER (PARTITION BY c.path, c.line ORDER BY b.line_end - b.line_start, b.line_start DESC) AS r
FROM code c JOIN block b ON b.path = c.path AND c.line BETWEEN b.line_start AND b.line_end) WHERE r = 1""")
def lc6_smallest_compound(spark, d):
    """The innermost brace block around each line."""
    spans = src.blocks(spark, d).withColumn("entity_id", F.format_string("%012d", F.lit(10**11) - F.col("line_start")))
    got = intervals.enclosing_unit(src.code_lines(spark, d).select("path", "line"), spans, ["path", "line"])
    return got.select("path", "line", "line_start", "line_end", F.col("level").alias("depth"))


@code_query("SELECT path, function, line_start, max(line) FILTER (starts_with(text, 'template')) AS header FROM fn JOIN code USING (path) WHERE line BETWEEN line_start - 2 AND line_start - 1 GROUP BY ALL")
def lc7_template_header(spark, d):
    """The template line right before a definition, past comment lines only."""
    return intervals.header_before(src.functions(spark, d), src.code_lines(spark, d), "template", 2)


@code_query("""SELECT f.path, f.function, (SELECT count(*) FROM wr WHERE wr.path = f.path AND wr.line BETWEEN f.line_start AND f.line_end)::BIGINT AS changes,
(SELECT count(*) FROM call WHERE call.path = f.path AND call.line BETWEEN f.line_start AND f.line_end)::BIGINT AS operations,
(SELECT count(*) FROM clean WHERE clean.path = f.path AND clean.line BETWEEN f.line_start AND f.line_end AND contains(text, 'buf'))::BIGINT AS resources FROM fn f""")
def lc8_facts_in_span(spark, d):
    """How many writes, calls and lines with a buffer each function's lines hold."""
    facts = {"changes": src.writes(spark, d), "operations": src.calls(spark, d), "resources": src.bodies(spark, d).where(F.col("text").contains("buf"))}
    return intervals.counts_within(src.functions(spark, d), ["function"], facts, src.text_buckets(spark, d))


@code_query("""+s AS (SELECT w.path, w.line, w.function, w.lhs FROM wr w), g AS (SELECT s.path, s.line, list(cond ORDER BY b.line_end - b.line_start, b.line_start DESC) AS conds FROM s JOIN guard b ON b.path = s.path AND s.line BETWEEN b.line_start AND b.line_end GROUP BY ALL)
SELECT s.path, s.line, s.function, s.lhs, f.line_start AS unit_start, coalesce(array_to_string(conds, ' && '), '') AS guard, (SELECT count(*) FROM wr o WHERE o.path = s.path AND o.line BETWEEN s.line - 3 AND s.line + 3)::BIGINT AS around
FROM s JOIN fn f USING (path, function) LEFT JOIN g USING (path, line)""")
def lc9_site_cards(spark, d):
    """Each write with its unit, the condition it runs under, and the writes three lines around it."""
    w = src.writes(spark, d).select("path", "line", "function", "lhs")
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    order = F.struct((F.col("line_end") - F.col("line_start")).alias("w"), (-F.col("line_start")).alias("s"), "cond")
    conds = intervals.innermost(w.select("path", "line"), g, ["path", "line"]).groupBy("path", "line").agg(F.sort_array(F.collect_list(order)).alias("x"))
    near = Window.partitionBy("path").orderBy("line").rangeBetween(-3, 3)
    base = w.withColumn("around", F.count(F.lit(1)).over(near)).join(src.functions(spark, d), ["path", "function"]).join(conds, ["path", "line"], "left")
    return base.select("path", "line", "function", "lhs", F.col("line_start").alias("unit_start"), F.coalesce(source_text.joined_guards(F.col("x.cond")), F.lit("")).alias("guard"), "around")


@code_query(r"""SELECT c.path, c.line, CASE WHEN b.line_end IS NULL THEN c.line ELSE b.line_end END::INT AS last FROM code c LEFT JOIN block b ON b.path = c.path AND b.line_start = c.line""")
def lc11_whole_statements(spark, d):
    """The last line of the statement that begins on each line: of its block if it opens one."""
    opened = src.blocks(spark, d).select("path", F.col("line_start").alias("line"), "line_end")
    return src.code_lines(spark, d).select("path", "line").join(opened, ["path", "line"], "left").select("path", "line", F.coalesce("line_end", "line").alias("last"))


@code_query("SELECT w.path, w.line, regexp_extract(f.function, '^\\w+') AS owner, f.line_start FROM wr w JOIN fn f USING (path, function)")
def lc3_owner_of_member(spark, d):
    """The type that owns the function around each write."""
    spans = src.functions(spark, d).withColumn("entity_id", F.col("function"))
    got = intervals.enclosing_unit(src.writes(spark, d).select("path", "line"), spans, ["path", "line"])
    return got.select("path", "line", F.split_part("function", F.lit("::"), F.lit(1)).alias("owner"), "line_start")


@code_query("""SELECT path, line, function FROM (SELECT c.path, c.line, f.function, row_number() OVER (PARTITION BY c.path, c.line ORDER BY f.line_end - f.line_start, f.function) AS r FROM code c JOIN fn f ON f.path = c.path AND c.line BETWEEN f.line_start AND f.line_end WHERE f.line_end > f.line_start) WHERE r = 1""")
def lc1_enclosing_definition(spark, d):
    """The smallest definition with a body around each line."""
    spans = src.functions(spark, d).withColumn("entity_id", F.col("function"))
    return intervals.enclosing_unit(src.code_lines(spark, d).select("path", "line"), spans, ["path", "line"]).select("path", "line", "function")


@code_query("""SELECT path, function, line_start, line_end, greatest(line_start, coalesce((SELECT max(o.line_end) + 1 FROM fn o WHERE o.path = f.path AND o.line_start < f.line_start AND o.line_end >= f.line_start AND o.line_end < f.line_end), 0))::INT AS body_start FROM (SELECT path, function, line_start, (line_end + 3)::INT AS line_end FROM fn) f""".replace("FROM fn o", "FROM (SELECT path, line_start, line_end + 3 AS line_end FROM fn) o"))
def rm21_clamped_starts(spark, d):
    """Definition spans, widened by three lines, whose bodies begin after any neighbour that reaches into them."""
    spans = src.functions(spark, d).withColumn("line_end", F.col("line_end") + 3)
    return intervals.clamp_starts(spans, ["path", "function"])


@code_query("SELECT path, line, function, lhs, rhs, (row_number() OVER (PARTITION BY lhs ORDER BY path, line))::INT AS position, count(*) OVER (PARTITION BY lhs) <= 8 AS complete FROM wr QUALIFY row_number() OVER (PARTITION BY lhs ORDER BY path, line) <= 8")
def wn6_value_timeline(spark, d):
    """The first eight writes of each name in source order, and whether those are all."""
    w = src.writes(spark, d).withColumn("complete", F.count(F.lit(1)).over(Window.partitionBy("lhs")) <= 8)
    got = traverse.top_per(w, ["lhs"], ["path", "line"], 8)
    return got.withColumnRenamed("rank", "position")


@code_query("""+g AS (SELECT w.path, w.line, list(cond ORDER BY b.line_end - b.line_start, b.line_start DESC)[1:3] AS conds FROM clean w JOIN guard b ON b.path = w.path AND w.line > b.line_start AND w.line <= b.line_end GROUP BY ALL)
SELECT path, line, array_to_string(list_transform(conds, lambda c: CASE WHEN contains(regexp_replace(regexp_replace(c, '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g'), '||') THEN '(' || c || ')' ELSE c END), ' && ') AS guard FROM g""")
def wn5_joined_guards(spark, d):
    """The condition under which each line runs: its innermost guards, at most three, joined."""
    g = src.guards(spark, d).withColumn("entity_id", F.col("line_start").cast("string"))
    around = intervals.innermost(src.bodies(spark, d).select("path", "line"), g, ["path", "line"])
    listed = around.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("depth", "cond"))).alias("x"))
    return listed.select("path", "line", source_text.joined_guards(F.col("x.cond")).alias("guard"))


def _tiny(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@code_query("""+f AS (SELECT DISTINCT path FROM code), q AS (SELECT unnest(['**/M12_CPP*', 'op_host/m0*', '**/zzz9']) AS pattern, unnest(['m12cpp', NULL, 'zzz9']) AS core)
SELECT pattern, list_sort(list(path))[1:6] AS nearest FROM q JOIN f ON contains(regexp_replace(lower(path), '[^a-z0-9]', '', 'g'), core) GROUP BY pattern""")
def sf10_nearest_paths(spark, d):
    """For globs that select no file: the first six paths that hold their longest literal, spelled without case and separators."""
    files = src.code_lines(spark, d).select("path").distinct()
    out = None
    for glob in ("**/M12_CPP*", "op_host/m0*", "**/zzz9"):
        near = text.nearest_paths(files, glob)
        out = near if out is None else out.unionByName(near)
    return out
