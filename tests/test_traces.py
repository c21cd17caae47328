"""Batched traces against a walk per request, one after another."""

import random
import re

import pytest

from quern.operators import traces
from quern.operators.traces import Family

FAMILIES = [Family("call", "", ("C",), 3, 6), Family("data", "write", ("W", "V"), 2, 80), Family("path", "", ("C", "W", "R"), 5, 9)]


def ident(name):
    return bool(re.fullmatch(r"[A-Za-z_]\w*", name.replace(".", "::").split("::")[-1].strip()))


def one_walk(starts, goals, names, edges, family, fanout):
    """(explored, path or None, bound) of a request in a family."""
    out = {}
    for kind, src, dst in sorted(set(edges)):
        if kind in family.kinds and dst in names:
            out.setdefault(src, []).append(dst)
    first = {s: list(dict.fromkeys(d[:fanout])) for s, d in out.items()}
    path = {s: [s] for s in starts}
    level = sorted(starts)
    for hop in range(1, family.depth + 1):
        near = {}
        for s in level:
            for d in first.get(s, []):
                if d not in path and (ident(names[d]) or d in goals):
                    near[d] = min(near.get(d, path[s] + [d]), path[s] + [d])
        level = sorted(near)[: max(0, family.budget - len(path))]
        path |= {d: near[d] for d in level}
        hit = [d for d in level if d in goals]
        if hit:
            return len(path), path[hit[0]], False
        if not level:
            break
    deep = any(len(p) == family.depth + 1 and first.get(d) for d, p in path.items())
    return len(path), None, len(path) >= family.budget or deep


def brute(requests, names, edges, families, fanout, homonyms):
    keys = {}
    for i in sorted(names):
        for k in {names[i], names[i].replace(".", "::").split("::")[-1].strip()}:
            keys.setdefault(k, []).append(i)
    result = {}
    for r, a, b in requests:
        starts, goals = set(keys.get(a, [])[:homonyms]), set(keys.get(b, [])[:homonyms])
        if not starts or not goals:
            result[r] = ("NO_SEED", None, None, None, 0, 0)
            continue
        walks = [one_walk(starts, goals, names, edges, f, fanout) for f in families]
        clean = [(i, p) for i, (_, p, _) in enumerate(walks) if p and all(ident(names[x]) for x in p)]
        explored = sum(w[0] for w in walks)
        if clean:
            i, p = clean[0]
            result[r] = ("COMPLETE", families[i].name, len(p) - 1, p, len(clean), explored)
        else:
            result[r] = ("SEARCH_BUDGET" if any(w[2] for w in walks) else "NO_PATH", None, None, None, 0, explored)
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traces_equal_a_walk_per_request(spark, seed):
    rng = random.Random(seed)
    pool = [f"N::f{i}" for i in range(25)] + [f"g{i % 7}" for i in range(30)] + ["a > b", "x.y z", "p == q", "m.ok"]
    names = {f"id{i:03d}": n for i, n in enumerate(pool)}
    edges = [(rng.choice("CWRVZ"), *rng.choices(list(names), k=2)) for _ in range(220)] + [("C", "id000", "gone"), ("C", "id000", "id000")]
    spelled = [*(f"f{i}" for i in range(25)), *(f"N::f{i}" for i in range(5)), *(f"g{i}" for i in range(7)), "a > b", "p == q", "ok", "nowhere", None]
    requests = [(i, rng.choice(spelled), rng.choice(spelled)) for i in range(150)]
    frame = spark.createDataFrame(requests, "request long, from_name string, to_name string")
    got = traces.traces(frame, spark.createDataFrame(list(names.items()), "id string, name string"), spark.createDataFrame(edges + edges[:20], "kind string, src string, dst string"), FAMILIES, fanout=3, homonyms=3)
    found = {r.request: (r.status, r.family, r.hops, r.path, r.families, r.explored) for r in got.collect()}
    assert found == brute(requests, names, edges, FAMILIES, 3, 3)
    assert {"COMPLETE", "NO_SEED", "SEARCH_BUDGET"} <= {v[0] for v in found.values()}


def test_all_statuses_and_empty_tables(spark):
    names = spark.createDataFrame([(c, c) for c in "abcdefgh"], "id string, name string")
    edges = spark.createDataFrame([("C", x, y) for x, y in zip("abcdefg", "bcdefgh", strict=True)], "kind string, src string, dst string")
    requests = spark.createDataFrame([(1, "a", "d"), (2, "a", "h"), (3, "h", "a"), (4, "a", "zz"), (5, "a", "a")], "request long, from_name string, to_name string")
    family = [Family("call", "", ("C",), 3, 80)]
    got = {r.request: r.status for r in traces.traces(requests, names, edges, family).collect()}
    assert got == {1: "COMPLETE", 2: "SEARCH_BUDGET", 3: "NO_PATH", 4: "NO_SEED", 5: "SEARCH_BUDGET"}
    assert {r.status for r in traces.traces(requests, names.limit(0), edges, family).collect()} == {"NO_SEED"}
    assert {r.status for r in traces.traces(requests, names, edges.limit(0), family).collect()} == {"NO_PATH", "NO_SEED"}
    assert traces.traces(requests.limit(0), names, edges, family).count() == 0


def test_a_hop_does_not_deal_the_edges_anew(spark):
    """The bucketed edges meet the frontier without an exchange of their own."""
    from quern.sources.staging import bucketed

    edges = spark.range(5000).selectExpr("cast(id as string) src", "cast(id % 3 as int) family", "id dst")
    frontier = spark.range(4000).selectExpr("cast(id as string) src", "cast(id % 3 as int) family")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with bucketed(edges, "t", ["src", "family"]) as stored:
            joined = frontier.join(stored, ["src", "family"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_walks_that_meet_in_a_symbol_share_its_list(spark, monkeypatch):
    """A hop holds a row per walk, not one per symbol, and reads a symbol's targets once for all walks."""
    staged = {}

    def counted(frame, name, keep=traces.stage):
        out = keep(frame, name)
        staged.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(traces, "stage", counted)
    names = [(f"r{i}", f"r{i}") for i in range(60)] + [("hub", "hub")] + [(f"t{i:02d}", f"t{i:02d}") for i in range(9)] + [(f"b{i}", f"x > {i}") for i in range(60)]
    edges = [("C", f"r{i}", "hub") for i in range(60)] + [("C", "hub", f"t{i:02d}") for i in range(9)] + [("C", f"b{i}", f"r{i}") for i in range(60)]
    requests = spark.createDataFrame([(i, f"r{i}", "t08") for i in range(60)], "request long, from_name string, to_name string")
    found = traces.walks(requests, spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(edges, "kind string, src string, dst string"), [Family("call", "", ("C",), 3, 80)]).collect()
    assert {(r.explored, r.hops, tuple(r.path), r.bound) for r in found} == {(11, 2, (f"r{i}", "hub", "t08"), False) for i in range(60)}
    assert staged["hop"] == [60, 60]
    assert staged["lists"][0] == 1
