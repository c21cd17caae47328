import pytest
from pyspark.sql import functions as F

from quern.functions import predicates
from quern.operators import merge, traverse
from quern.plans import service
from quern.streaming import changes


def test_predicates():
    tree = predicates.parse("layout == TND && s == 0")
    assert tree["op"] == "AND" and [a["op"] for a in tree["args"]] == ["EQ", "EQ"]
    assert predicates.parse("coreNum / 2") == {"op": "DIV", "args": [{"op": "REF", "value": "coreNum"}, {"op": "INT", "value": "2"}]}
    flat = predicates.flatten(predicates.parse('strcmp(x, "TND") == 0'))
    assert flat["literals"] == ["TND", "0"] and flat["operators"] == ["EQ", "STRCMP"]
    assert predicates.parse("a ? b")["op"] == "RAW"
    assert predicates.parse("if (x == 1) {") == predicates.parse("x == 1") == predicates.parse("for (int i = 0; x == 1; i++)")
    flat = predicates.flatten(predicates.parse("fmt == ns::LAYOUT_TND && static_cast<int32_t>(n->size) >= 1.5f || !done(true)[k] ^ 0x1F"))
    assert flat["enum_values"] == ["LAYOUT_TND", "LAYOUT", "TND"] and flat["literals"] == ["1.5", "true", "31"] and flat["references"] == ["fmt", "size", "k"]
    assert flat["operators"] == ["OR", "AND", "EQ", "GE", "BITXOR", "NOT", "CALL"]
    assert predicates.evaluate(predicates.parse("a > 1 ? b : 2.5"), {"a": 0, "b": 1}) == 2.5
    assert predicates.evaluate(predicates.parse("a / 0 == 0 || b"), {"a": 4}) is True
    assert predicates.evaluate(predicates.parse("a && b"), {"a": 1}) is None


def test_predicate_udf(spark):
    frame = spark.createDataFrame([("a == 1",), (None,), ("x <",)], "p string").select(predicates.parse_predicate("p").alias("r"))
    assert [r.r.operators for r in frame.collect()] == [["EQ"], [], []]
    held = frame.select(predicates.holds(F.col("r"), operator="eq", literal="1", symbol="A").alias("h"))
    assert [r.h for r in held.collect()] == [True, False, False]
    predicates.register(spark)
    assert spark.sql("SELECT parse_predicate('x < LAYOUT_A').enum_values AS e").first().e == ["LAYOUT_A", "LAYOUT"]


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in traverse.reach(start, edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.id: r.path for r in traverse.shortest_paths(start, edges, 3).collect()}["d"] == ["a", "b", "c", "d"]
    assert {r.id for r in traverse.propagate_flag(spark.createDataFrame([("d",)], "id string"), edges).collect()} == {"a", "b", "c", "d"}
    assert {tuple(r) for r in traverse.topo_levels(edges).collect()} == {("x", 0), ("y", 1), ("a", 2), ("b", 2), ("c", 2), ("d", 2)}
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "src string, dst string")
    assert {(r.id, r.distance) for r in traverse.reach(spark.createDataFrame([("n00",)], "id string"), chain).collect()} == {(f"n{i:02d}", i) for i in range(21)}
    assert traverse.topo_levels(chain).where("level = 20").first().id == "n20"


def test_merge_trust_and_spans(spark):
    facts = [
        ("e", 1, None, "partial", 0.2, "x", "legacy_unknown", "f", 5, 6), ("e", 2, "n", "extracted", 0.9, None, "derived", "g", 1, 9), ("e", 3, "m", "partial", 0.5, "y", "authoritative", "h", 2, 3),
    ]
    row = merge.merge_entities(spark.createDataFrame(facts, "id string, seq int, name string, status string, confidence double, attr string, trust string, file string, line_start int, line_end int")).first()
    assert (row.name, row.status, row.confidence, row.attr, row.trust, row.file, row.line_end) == ("n", "extracted", 0.9, "y", "derived", "g", 9)
    legacy = spark.createDataFrame([("legacy_unknown",), ("authoritative",)], "trust string")
    assert legacy.agg(merge.derived_trust().alias("t")).first().t == "legacy_unknown"


def test_service(spark):
    frame = spark.range(25)
    first = service.answer(service.Request("search", {"pattern": "x", "bad": 1}), frame, ["id"], "s")
    assert first.total == 25 and len(first.rows) == 20 and first.next_cursor
    second = service.answer(service.Request("search", {"pattern": "x"}, cursor=first.next_cursor), frame, ["id"], "s")
    assert [r.id for r in second.rows] == [20, 21, 22, 23, 24] and second.next_cursor is None
    with pytest.raises(ValueError):
        service.Request("search", {"bad": 1}).checked()
    assert service.completeness(0, 0, 0, None, 0, 0, False)[0] == "UNKNOWN"
    assert service.completeness(1, 1, 1, "t", 0, 0, True) == ("INCOMPLETE", ["NO_SINK"])
    assert service.verdict("trace", "COMPLETE", True) == "PARTIAL"


def test_streamed_changes_equal_the_batch(spark, tmp_path):
    rows = [("a", "1", 1), ("b", "1", 2), ("a", "2", 3), ("c", "1", 4), ("b", "3", 5)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, sha string, seq long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, sha string, seq long").option("maxFilesPerTrigger", 2).json(f"{tmp_path}/in")
    changes.merge_changes(stream, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    got = {tuple(r) for r in changes.latest(spark, f"{tmp_path}/table").select("path", "sha", "seq").collect()}
    assert got == {tuple(r) for r in changes.batch_twin(spark.createDataFrame(rows, "path string, sha string, seq long")).collect()}


def test_open_flags_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("u", "set", "2024-01-01"), ("u", "wait", "2024-01-01"), ("v", "set", "2024-01-02")], "k string, r string, t string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, r string, t string").json(f"{tmp_path}/in").withColumn("t", F.to_timestamp("t"))
    q = changes.open_flags(stream, "k", "r", "t").writeStream.format("memory").queryName("flags").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.paired) for r in spark.table("flags").collect()} == {("u", True), ("v", False)}


def test_planned_requests(spark):
    symbols = spark.createDataFrame([("F:a", "FUNCTION", "Op::a"), ("F:b", "FUNCTION", "Op::b"), ("V:x", "FIELD", "x")], "id string, kind string, name string")
    edges = spark.createDataFrame([("CALLS", "F:a", "F:b"), ("WRITES", "F:b", "V:x")], "kind string, src string, dst string")
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(["one", "two", "three"], 1)], "path string, line int, text string")
    tables = {"lines": lines, "symbols": symbols, "edges": edges}
    ask = lambda operation, **filters: service.planned(tables, service.Request(operation, filters)).collect()
    assert {(r.id, r.direction) for r in ask("trace", symbol="b")} == {("V:x", "out"), ("F:a", "in")}
    assert [tuple(r.path) for r in ask("trace", symbol="a", to_symbol="x")] == [("F:a", "F:b", "V:x")]
    assert [r.text for r in ask("source", file="./p", line=2)] == ["two"]
    assert [r.id for r in ask("search", pattern="op", kind="FUNCTION")] == ["F:a", "F:b"]
    for operation, filters in (("source", {"file": "p"}), ("trace", {"relation": "CALLS"}), ("search", {"kind": "FUNCTION"})):
        with pytest.raises(ValueError, match="INVALID_QUERY"):
            ask(operation, **filters)


def test_enumerators_and_nearest_paths(spark):
    from quern.functions.predicates import flatten, parse
    from quern.operators.text import nearest_paths

    got = flatten(parse('mode == FAST_MODE && x == DT_INT8 || strcmp(s, "SLOW") == 0'))
    assert got["enum_values"] == ["FAST_MODE", "FAST", "MODE", "DT_INT8", "DT", "INT8", "SLOW"]
    assert got["references"] == ["mode", "x", "s"]
    files = spark.createDataFrame([("op_host/tiling_data.h",), ("op_host/other.h",)], "path string")
    pick = lambda g: [r.nearest for r in nearest_paths(files, g).collect()]
    assert pick("no_such_folder/TilingData*") == [["op_host/tiling_data.h"]]
    assert pick("*.h") == [] and pick("zzzz*") == [] and pick("?*") == []


def test_changed_compares_missing_hashes(spark):
    from quern.operators.audit import changed

    old = spark.createDataFrame([("a", None), ("b", None), ("c", "1")], "path string, sha string")
    new = spark.createDataFrame([("a", None), ("b", "2"), ("d", None)], "path string, sha string")
    assert {tuple(r) for r in changed(old, new).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}


def _shuffles(frame):
    """Exchanges by hash in the plan, as first laid out."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_edges_of_a_named_symbol_are_found_where_they_lie(spark, tmp_path):
    edges = spark.range(20000).selectExpr("'C' kind", "concat('f', id) src", "concat('f', id + 1) dst", "1L n_sites", "1 first_line")
    symbols = spark.range(20000).selectExpr("concat('f', id) id", "'FUNCTION' kind", "concat('F', id) name")
    edges.write.parquet(f"{tmp_path}/edges")
    symbols.write.parquet(f"{tmp_path}/symbols")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        tables = {"edges": spark.read.parquet(f"{tmp_path}/edges"), "symbols": spark.read.parquet(f"{tmp_path}/symbols")}
        found = service.planned(tables, service.Request("trace", {"symbol": "F7"}))
        assert _shuffles(found) == 0
        assert sorted((r.id, r.direction) for r in found.collect()) == [("f6", "in"), ("f8", "out")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fields_come_from_their_own_table(spark):
    """What joins with the few fields is not dealt because the table of all symbols is large."""
    from quern.plans import catalog_passes, encode_code

    d = "/root/testdata/sf0.001"
    own = encode_code.symbols(spark, d).where("kind = 'FIELD'")
    fields = catalog_passes._fields(spark, d)
    assert fields.schema.simpleString() == own.schema.simpleString() and fields.exceptAll(own).isEmpty() and own.exceptAll(fields).isEmpty()
    assert not any("code_symbols" in f for f in fields.inputFiles())
