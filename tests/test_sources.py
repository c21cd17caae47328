import random

import pytest
from pyspark.sql import functions as F

from quern.functions import dsl, source_text
from quern.operators import code, gramindex, text
from quern.sources import numbered, snapshot
from quern.sources.versions import ScanCache, Versions


def graph(spark, n):
    entity = spark.createDataFrame([(f"e{i}", "K" if i % 2 else "L") for i in range(n)], "id string, kind string")
    return {"entity": entity}


def test_snapshots_are_replaced_whole_and_stay_open(spark, tmp_path):
    root = f"{tmp_path}/p/one"
    with pytest.raises(FileNotFoundError):
        snapshot.Snapshot(spark, root)
    snapshot.write(root, graph(spark, 3), {"digest": "d1"}, {"entity": "id"})
    old = snapshot.shared(spark, root)
    assert old is snapshot.shared(spark, root)
    snapshot.write(root, graph(spark, 5), {"digest": "d2"})
    new = snapshot.shared(spark, root)
    assert (old.table("entity").count(), new.table("entity").count(), new.table("entity", ["K"]).count()) == (3, 5, 2)
    assert snapshot.products(spark, f"{tmp_path}/p") == ["one"]
    new.store_view("v", spark.range(2))
    assert new.view("v").count() == 2
    new.upsert_meta(digest="d3")
    with pytest.raises(ValueError):
        new.view("v")
    assert new.upgrade({"more": lambda s: s.table("entity")}) == ["more"] and new.upgrade({"more": lambda s: s.table("entity")}) == []


def test_pool_holds_four(spark, tmp_path):
    for i in range(6):
        snapshot.write(f"{tmp_path}/{i}", graph(spark, 1), {})
        snapshot.shared(spark, f"{tmp_path}/{i}")
    assert len(snapshot._POOL) == snapshot.POOL_SIZE


def test_parsers():
    found = dsl.declared("ARGS_DECL(Op, UINT_DECL(D, 4, 1, 2), BOOL_DECL(B, 0, 1)) ARGS_SEL(UINT_SEL(D, 1), BOOL_SEL(B, 1))")
    assert [(x["block"], x["name"], x["bit_lo"], x["bit_hi"], x["values"]) for x in found] == [(0, "D", 0, 3, ["1", "2"]), (0, "B", 4, 4, ["0", "1"]), (1, "D", 0, 7, ["1"]), (1, "B", 8, 8, ["1"])]
    assert dsl.declared("ARGS_DECL(") == [] and dsl.struct_fields("nothing") == [] and dsl.operator_params("") == []
    assert source_text.split_top('a, f(b, c), "d, e", g<h, i>') == ["a", "f(b, c)", '"d, e"', "g<h, i>"] and source_text.split_top("") == []


def test_masking_keeps_places():
    for line in ('x = "a // b"; // c', "a /* b */ c", "'\"' + \"\\\"\"; /* d", ""):
        assert len(source_text.masked(line)[0]) == len(line)
    assert source_text.masked('x = "a // b"; // c')[0] == 'x = "      ";     '
    assert source_text.masked("b */ c", True) == ("     c", False) and source_text.masked("a /* b")[1]


def test_guards_are_joined_without_reading_wrong(spark):
    rows = [(["a || b", "for (i)", "f(x || y)", "c"],), ([],)]
    got = spark.createDataFrame(rows, "g array<string>").select(source_text.joined_guards(F.col("g")).alias("j")).collect()
    assert [r.j for r in got] == ["(a || b) && f(x || y) && c", ""]
    assert [source_text.plain_negation(x) for x in ("!(x)", "!(!x)", "!(!a && b)", "!(a) && b", "!(!(a || b))")] == ["!x", "x", "!(!a && b)", "!(a) && b", "(a || b)"]


def test_blocks_nest(spark):
    lines = ["f() {", "if (a) {", "}", "if (b) { g(); }", "while (c) {", "x = 1;", "}", "}"]
    frame = spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(lines)], "path string, line int, text string")
    assert {(r.line_start, r.line_end, r.level) for r in code.blocks(frame).collect()} == {(1, 8, 1), (2, 3, 2), (5, 7, 2)}


def test_macros_expand_inside_macros(spark):
    lines = spark.createDataFrame([("p", 1, "y = A + B2 + AB;")], "path string, line int, text string")
    macros = spark.createDataFrame([("A", "(B2)"), ("B2", "C * 2"), ("C", "7")], "name string, value string")
    assert text.expand(lines, ["path", "line"], macros).first().text == "y = (7 * 2) + 7 * 2 + AB;"


WORDS = ["Hello World", "hell", "lo", "", "HELLO", "buf1.Set(v2)", "OP_CHECK(v1 != 3, return);", "aXbXc", "tötal1", "x = total3;", "ab\\cd", "İstanbul hello", "ΑΣ total", "aaa", "abcabc"]
PATTERNS = [
    "ello", "lo", "zzz", "hel", "total[13]", "total[13]|Set", "(buf|OP)[_1]", r"v\d+", "hel+o", "(?:abc){2}", "(abc)?a", "h.*ld", "(?i)op_check", r"\bhell\b", "^hell$", "a(X|Y)b(X|Z)c",
    "(abc|xyz)|def", "tötal", "[a-z]{3}", "x*", "(", "ΑΣ", r"\\cd", "(?=hello)h", "(?P<n>hell)o", "[^a]bc", "hello|", "total[0-9]", "(?:to|ta)(?:tal|lat)",
]


def test_indexed_search_is_the_scan(spark):
    import re

    rng = random.Random(2)
    rows = [(f"f{i % 7}", i, rng.choice(WORDS) + rng.choice(["", " ", rng.choice(WORDS)])) for i in range(3000)]
    lines = spark.createDataFrame(rows, "path string, line int, text string")
    index = gramindex.build(lines).cache()
    for pattern in PATTERNS:
        if pattern == "(":
            assert gramindex.required(pattern) == gramindex.ANY
            continue
        got = {(r.path, r.line) for r in gramindex.search(lines, index, pattern, "f1").collect()}
        literal = text.is_literal(pattern)
        holds = (lambda t: pattern.lower() in t.lower()) if literal else (lambda t: re.search(pattern, t))  # noqa: B023
        assert got == {(p, i) for p, i, t in rows if holds(t) and p == "f1"}, pattern
    assert gramindex.search(lines.limit(0), index.limit(0), "hello").count() == 0


def test_required_grams():
    for pattern in ("ello", "total[13]", "total[13]|Set", "hel+o", "(?:abc){2}", "(?i)op_check", r"\bhell\b", "^hell$", "a(X|Y)b(X|Z)c", "(abc|xyz)|def", "total[0-9]", "(?:to|ta)(?:tal|lat)", "(?P<n>hell)o"):
        assert gramindex.required(pattern).op != "any", pattern
    for pattern in ("lo", r"v\d+", "x*", "(abc)?a", "h.*ld", "ΑΣ", "hello|", "abc|d", "[^a]bc", "("):
        assert gramindex.required(pattern) == gramindex.ANY, pattern
    tree = gramindex.required("set_(f1|g2)x|Pick")
    assert tree.op == "or" and {"set", "et_", "pic", "ick", "_f1", "g2x"} <= tree.grams()
    assert gramindex.required("ab[cd]e").grams() == {"abc", "bce", "abd", "bde"} and gramindex.required("ab.*cde").grams() == {"cde"}


def test_a_search_reads_only_its_grams(spark, tmp_path):
    lines = spark.createDataFrame([(f"f{i}", i, WORDS[i % len(WORDS)]) for i in range(300)], "path string, line int, text string")
    gramindex.build(lines).write.partitionBy("part").parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    tree = gramindex.required("total[13]")
    read = gramindex.postings(index, tree.grams())
    folders = {f.split("part=")[1].split("/")[0] for f in read.inputFiles()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "In(gram" in plan.replace(" ", "")
    files = read._jdf.queryExecution().executedPlan().toString()
    assert len(folders) > len(tree.grams()) and files  # all folders are listed, the filter leaves those of the grams
    assert {r.part for r in read.select("part").distinct().collect()} <= {gramindex.zlib.crc32(g.encode()) % gramindex.PARTS for g in tree.grams()}


def test_the_index_is_built_where_the_lines_lie(spark, tmp_path):
    import re

    lines = spark.createDataFrame([(f"f{i % 3}", i, WORDS[i % len(WORDS)]) for i in range(4000)], "path string, line int, text string")
    assert "Exchange" not in gramindex.build(lines)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = snapshot.lookup_table(spark, str(tmp_path), "grams", lambda: gramindex.build(lines), "gram", "part", deal=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.groupBy("gram", "path", "block").count().where("count > 1").count() > 0  # blocks in several batches
    got = {(r.path, r.line) for r in gramindex.search(lines, index, "total[13]").collect()}
    assert got == {(r.path, r.line) for r in lines.collect() if re.search("total[13]", r.text)} and got


def test_a_version_is_current_or_not_there(spark, tmp_path, monkeypatch):
    """A writer that dies between any two steps leaves the version before; two can't take one number."""
    root = f"{tmp_path}/s"
    snapshot.write(root, graph(spark, 1), {})
    append = numbered.append
    monkeypatch.setattr(numbered, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        snapshot.write(root, graph(spark, 2), {})
    monkeypatch.setattr(numbered, "append", append)
    assert snapshot.Snapshot(spark, root).table("entity").count() == 1
    (tmp_path / "s" / "current" / "2").touch()  # the number taken, the name not yet written
    assert snapshot.Snapshot(spark, root).table("entity").count() == 1
    version = snapshot.write(root, graph(spark, 3), {})
    assert numbered.last(spark, f"{root}/current") == (3, version) and snapshot.Snapshot(spark, root).table("entity").count() == 3
    with pytest.raises(numbered.Overtaken):
        numbered.append(spark, f"{root}/current", "late", above=1)
    old = snapshot.Snapshot(spark, root)
    old.upsert_meta(a="1", b="1")
    old.upsert_meta(a="2")
    assert (old.meta()["a"], old.meta()["b"]) == ("2", "1") and spark.read.parquet(f"{root}/{version}/meta").where("key = 'a'").count() == 0


def test_a_changed_source_is_read_anew(spark, tmp_path):
    source = f"{tmp_path}/src"
    build = lambda: spark.read.parquet(f"{source}/t.parquet")
    spark.range(3).write.parquet(f"{source}/t.parquet")
    assert snapshot.lookup_table(spark, source, "t", build, "id").count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert snapshot.lookup_table(spark, source, "t", build, "id").count() == 5


def test_only_touched_buckets_are_written(spark, tmp_path, monkeypatch):
    table = Versions(spark, f"{tmp_path}/v", "path", 16)
    with pytest.raises(FileNotFoundError):
        table.read()
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha string")
    first = [(f"p{i}", "a") for i in range(200)]
    assert table.apply(frame(first)) == list(range(16))
    before = table.manifest()[1]["buckets"]
    touched = table.apply(frame([("p3", "b"), ("new", "c")]), frame([("p5", "")]).select("path"))
    after = table.manifest()[1]["buckets"]
    assert 1 <= len(touched) <= 3 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    expected = {p: s for p, s in first if p != "p5"} | {"p3": "b", "new": "c"}
    assert {r.path: r.sha for r in table.read().collect()} == expected and table.read().count() == len(expected)
    assert table.read(1).count() == 200
    # A writer that dies before its manifest leaves the version before.
    append = numbered.append
    monkeypatch.setattr(numbered, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        table.apply(frame([("p1", "z")]))
    # One that is overtaken keeps what overtook it.
    def overtaken(spark_, folder, text, above=None):
        monkeypatch.setattr(numbered, "append", append)
        Versions(spark, f"{tmp_path}/v", "path", 16).apply(frame([("p2", "other"), ("p1", "other")]))
        return append(spark_, folder, text, above)
    monkeypatch.setattr(numbered, "append", overtaken)
    table.apply(frame([("p1", "late")]))
    assert {r.path: r.sha for r in table.read().collect()} == expected | {"p2": "other", "p1": "late"}
    assert table.apply(frame([("p1", "x")]), batch=("s", 4)) and table.apply(frame([("p1", "y")]), batch=("s", 4)) == []
    everything = table.read().select("path")
    table.apply(frame([]), everything)
    assert table.read().count() == 0


def test_only_missing_contents_are_scanned(spark, tmp_path):
    calls = []

    def scanner(rows):
        calls.append(rows.count())
        return rows.select("sha", F.length("text").alias("facts")).where("facts > 2")

    files = lambda rows: spark.createDataFrame(rows, "path string, sha string, text string")
    old = [(f"p{i}", f"s{i % 6}", "x" * (i % 6)) for i in range(10)] + [("null", None, "abc")]
    cache = ScanCache(spark, f"{tmp_path}/c", "v1")
    got, scanned = cache.scan(files(old), scanner)
    assert scanned == 6 and {r.path: r.facts for r in got.collect()} == {p: len(t) if s and len(t) > 2 else None for p, s, t in old}
    again = ScanCache(spark, f"{tmp_path}/c", "v1")
    assert again.scan(files(old), scanner)[1] == 0
    new = old[:5] + [("p5", "n1", "12345"), ("p6", "n2", "1234567")]
    got, scanned = again.scan(files(new), scanner)
    assert scanned == 2 and {r.path: r.facts for r in got.collect()}["p6"] == 7
    assert ScanCache(spark, f"{tmp_path}/c", "v2").scan(files(old), scanner)[1] == 6
    again.keep(files(new))
    assert again.scan(files(new), scanner)[1] == 0 and again.scan(files(old), scanner)[1] == 1
    assert cache.scan(files([]), scanner)[1] == 0
