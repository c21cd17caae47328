"""Slices with budgets against a search per request."""

import random

from quern.operators import traverse


def searched(start, edges, depth, budget):
    """The first nodes by (distance, id), and whether more lie within ``depth``."""
    seen, level = {n: 0 for n in start}, set(start)
    for hop in range(1, depth + 1):
        level = {b for a, b in edges if a in level} - set(seen)
        seen |= {n: hop for n in level}
    order = sorted(seen, key=lambda n: (seen[n], n))
    return {n: seen[n] for n in order[:budget]}, len(order) > budget


def test_slices_equal_a_search_per_request(spark):
    rng = random.Random(11)
    node = lambda: f"n{rng.randrange(60):02}"
    edges = [(node(), node()) for _ in range(120)] + [("n00", f"n{i:02}") for i in range(1, 50)]
    starts = {f"r{i}": {node() for _ in range(rng.randrange(1, 4))} for i in range(40)} | {"hub": {"n00"}, "nowhere": {"zz"}}
    seeds = spark.createDataFrame([(r, n) for r, ns in starts.items() for n in [*ns, *ns]], "request string, id string")
    frame = spark.createDataFrame(edges, "src string, dst string")
    cut = set()
    for depth, budget in ((0, 2), (2, 5), (3, 12), (4, 1000)):
        want = {r: searched(ns, edges, depth, budget) for r, ns in starts.items()}
        rows = traverse.slices(seeds, frame, depth, budget).collect()
        got = {r: ({x.id: x.distance for x in rows if x.request == r}, {x.truncated for x in rows if x.request == r}) for r in starts}
        assert got == {r: (nodes, {more}) for r, (nodes, more) in want.items()} and len(rows) == sum(len(n) for n, _ in want.values())
        cut |= {more for _, more in want.values()}
    assert cut == {True, False}


def shuffled_rows(spark):
    """Rows that all stages so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_slices_do_not_deal_the_neighbours_of_hubs_per_request(spark):
    edges = [(f"s{i:03}", f"h{i % 2}") for i in range(200)] + [(f"h{i % 2}", f"t{i:04}") for i in range(4000)]
    seeds = spark.createDataFrame([(f"s{i:03}", f"s{i:03}") for i in range(200)], "request string, id string")
    before = shuffled_rows(spark)
    rows = traverse.slices(seeds, spark.createDataFrame(edges, "src string, dst string"), 2, 8).collect()
    # Each request could be sent all of its hub's neighbours: 400,000 rows.
    assert shuffled_rows(spark) - before < 40_000
    assert sorted((x.id, x.distance, x.truncated) for x in rows if x.request == "s003") == [("h1", 1, True), ("s003", 0, True), *((f"t{i:04}", 2, True) for i in (1, 3, 5, 7, 9, 11))]
    assert len(rows) == 200 * 8
