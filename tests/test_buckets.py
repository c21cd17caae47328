"""Tables in buckets: what is derived per file moves no row, and follows the sources."""

import pytest
from pyspark.sql import functions as F

from quern.operators import code
from quern.plans import encode_code
from quern.sources import snapshot

DATA = "/root/testdata/sf0.001"


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["blocks", "functions", "spanned", "operations"])
def test_facts_per_file_are_found_without_a_shuffle(spark, name):
    found = {
        "blocks": lambda: code.blocks(encode_code.code_lines(spark, DATA)), "functions": lambda: code.functions(encode_code.scanned(spark, DATA)),
        "spanned": lambda: code.spanned(code.enclosing_function(encode_code.code_lines(spark, DATA))), "operations": lambda: encode_code.calls(spark, DATA).groupBy("path", "function").count(),
    }
    assert exchanges(found[name]()) == 0


def test_text_is_written_where_its_items_lie(spark):
    assert exchanges(code.spanned(code.enclosing_function(encode_code._code_lines(spark, DATA)))) == 1


def test_buckets_follow_their_source(spark, tmp_path):
    source = f"{tmp_path}/in"
    build = lambda: spark.read.parquet(source).repartition(4, "id")
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        assert snapshot.bucket_table(spark, source, "b", build, "id").count() == n


def test_units_without_lines_keep_their_heads(spark):
    rows = [("p", 1, 1, "a"), ("p", 1, 2, None), ("p", 2, 1, None), ("q", 3, 1, "b")]
    items = spark.createDataFrame(rows, "path string, o int, at int, text string")
    lines = F.when(F.col("text").isNotNull(), F.array("text", "text"))
    got = encode_code.numbered(items, ["at"], F.array(F.concat(F.lit("head"), F.col("o").cast("string"))), lines)
    found = sorted(tuple(r) for r in got.collect())
    assert found == [("p", 1, "head1"), ("p", 2, "a"), ("p", 3, "a"), ("p", 4, "}"), ("p", 5, "head2"), ("p", 6, "}"), ("q", 1, "head3"), ("q", 2, "b"), ("q", 3, "b"), ("q", 4, "}")]


def test_flow_tables_are_built_from_one_shuffle_of_items(spark):
    from quern.plans import encode_flow, encode_kernels

    assert exchanges(encode_flow._functions(spark, DATA)) == 1
    assert exchanges(code.enclosing_function(encode_kernels._kernel_lines(spark, DATA))) == 1


def test_equal_items_take_turns(spark):
    items = spark.createDataFrame([("p", 1, 1, "a"), ("p", 1, 1, "a")], "path string, o int, j int, text string")
    got = encode_code.interleaved(items, F.array(F.lit("head")), F.array("text", F.lit("b"))).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.line)] == ["head", "a", "a", "b", "b", "}"]


def test_fitted_cards_send_no_table_to_all_tasks(spark):
    from quern.plans.registered import QUERIES

    assert "Broadcast" not in QUERIES["tk12_fitted_cards"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_lines_within_functions_are_neither_moved_nor_sorted(spark):
    plan = encode_code.bodies(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan and "Sort " not in plan and "SortMergeJoin" not in plan


def test_buckets_follow_the_rows_of_their_table(spark, monkeypatch):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(snapshot, "BUCKET_ROWS", rows // 9)
    assert snapshot.buckets(spark, DATA, "lineitem") in (9, 10)
    monkeypatch.setattr(snapshot, "BUCKET_ROWS", rows)
    assert snapshot.buckets(spark, DATA, "lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_facts_are_counted_in_nested_and_touching_spans(spark):
    from quern.operators import intervals

    spans = [("p", "a", 1, 9), ("p", "b", 3, 5), ("p", "c", 5, 5), ("q", "a", 2, 4)]
    facts = {"x": [("p", 1), ("p", 5), ("p", 5), ("p", 10), ("q", 1)], "y": [("p", 3), ("q", 4), ("r", 1)]}
    frames = {k: spark.createDataFrame(v, "path string, line int") for k, v in facts.items()}
    got = intervals.counts_within(spark.createDataFrame(spans, "path string, function string, line_start int, line_end int"), ["function"], frames, 4).collect()
    count = lambda k, s: sum(p == s[0] and s[2] <= n <= s[3] for p, n in facts[k])
    assert sorted(tuple(r) for r in got) == sorted((s[0], s[1], count("x", s), count("y", s)) for s in spans)


def test_functions_spans_come_with_one_shuffle(spark):
    from quern.plans.registered import QUERIES

    assert exchanges(QUERIES["lc8_facts_in_span"](spark, DATA)) == 1


@pytest.mark.parametrize("name, apart", [("nm9_find", "call_edges"), ("rm40_field_classes", "call_edges"), ("ps1_reachable_calls", "write_edges"), ("ps22_root_trace", "write_edges")])
def test_queries_build_only_the_tables_they_read(spark, name, apart):
    from quern.plans.registered import QUERIES

    snapshot.forget(spark)
    QUERIES[name](spark, DATA)
    built = {key[2] for key in snapshot._STORED if key[0] == spark.sparkContext.applicationId}
    assert "code_calls" in built or "code_writes" in built
    assert built.isdisjoint({"code_symbols", "code_symbol_edges", f"code_{apart}"})


def test_tables_are_built_a_bucket_a_task(spark, tmp_path):
    """Small buckets are not packed into one task, which would be slow and uneven for what is read by Python."""
    from quern.sources.staging import stage

    source = str(tmp_path)
    base = lambda: snapshot.bucket_table(spark, source, "few", lambda: spark.range(400).select(F.col("id").cast("string").alias("path")).repartition(8, "path"), "path", n=8)
    built = snapshot.bucket_table(spark, source, "more", lambda: base().withColumn("task", F.spark_partition_id()), "path", n=8)
    assert built.select("task").distinct().count() == 8
    assert stage(base().withColumn("task", F.spark_partition_id()), "tasks").select("task").distinct().count() == 8
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"
