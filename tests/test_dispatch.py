"""Dispatch families against all pairs of bases and overrides."""

import random

import pytest

from quern.operators import dispatch, lineage

TEXTS = ["virtual void f() { }", "virtual void f() = 0;", "virtual void f();", "void f() override { x(); }", "void f() { y(); }", "void f();", "void f() override;", "virtual void f() { z(); }", None]
SCHEMA = "leaf string, id string, file string, line int, owner string, text string"


def brute(rows):
    best = {}
    for leaf, i, file, line, owner, text in rows:
        if not leaf:
            continue
        t = text or ""
        empty = "{ }" in t or "= 0;" in t
        m = {"leaf": leaf, "id": i, "file": file, "line": line, "owner": owner or "", "virtual": "virtual" in t, "override": "override" in t, "empty": empty, "has_body": "{" in t and not empty}
        m["stem"] = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        m["type"] = ("o", m["owner"]) if m["owner"] else ("f", m["stem"])
        at = (leaf, m["stem"], line)
        rank = (m["owner"] == "", not m["virtual"], i)
        if at not in best or rank < best[at][0]:
            best[at] = (rank, m)
    out = set()
    every = [m for _, m in best.values()]
    for leaf in {m["leaf"] for m in every}:
        own = [m for m in every if m["leaf"] == leaf]
        bases = [m for m in own if m["virtual"] and m["empty"]] or [m for m in own if m["virtual"]]
        over = [m for m in own if m["override"] and m["has_body"]] or [m for m in own if m["has_body"] and any(b["type"] != m["type"] for b in bases)]
        for b in bases:
            for o in over:
                if b["type"] != o["type"]:
                    out |= {(leaf, r, m["id"], m["file"], m["line"], m["owner"]) for r, m in (("base", b), ("override", o))}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([f"run{i}" for i in range(40)] + ["", None]), f"id{i:04d}", f"{rng.choice(['a', 'b/c'])}/m{rng.randrange(9)}.{rng.choice(['h', 'cpp'])}", rng.randrange(4), rng.choice(["A", "B", "C", "", None]), rng.choice(TEXTS)) for i in range(260)]
    got = dispatch.families(dispatch.members(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_a_family_of_ten_thousand_members(spark):
    """One base and 10,000 overrides: every site reaches each of them, and no plan pairs members."""
    rows = [("run", "base", "a/base.h", 1, "Base", "virtual void run() { }")] + [("run", f"o{i}", f"a/m{i}.cpp", i, f"T{i}", "void run() override { x(); }") for i in range(10_000)]
    family = dispatch.families(dispatch.members(spark.createDataFrame(rows, SCHEMA)))
    sites = spark.createDataFrame([("s1", "run"), ("s2", "run"), ("s1", "run"), ("s3", "other")], "site string, leaf string")
    assert family.count() == 10_001 and dispatch.dispatch_edges(sites, family).count() == 20_000
    assert dispatch.families(dispatch.members(spark.createDataFrame([], SCHEMA))).count() == 0


def test_counts_of_owners_without_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(rng.choice("lmnop"), rng.choice("ABCD"), rng.random() < 0.3) for _ in range(40)] + [("z", "A", True), ("z", "A", False), ("y", "A", True)]
    pairs = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] and not y[2] and x[1] != y[1]}
    expected = {leaf: (len({p[1] for p in pairs if p[0] == leaf}), len({p[2] for p in pairs if p[0] == leaf})) for leaf in {p[0] for p in pairs}}
    got = lineage.override_families(spark.createDataFrame(rows, "leaf string, owner string, b boolean"), "leaf", "owner", F.col("b"))
    assert {r.leaf: (r.bases, r.overrides) for r in got.collect()} == expected
