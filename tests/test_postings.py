"""Covers of template blocks against sets of blocks, one request after another."""

import random

from quern.functions.names import truth_aliases
from quern.operators import postings

SPELLED = ["1", "true", "True", "0", "false", "x", "y"]


def brute(blocks, filters):
    """{dropped: (blocks, {dim: values})} of one request."""
    def meeting(some):
        return {b for b in {x[0] for x in blocks} if all(any(x[0] == b and x[1] == d and x[2] in (*truth_aliases(v), v) for x in blocks) for d, v in some.items())}

    def values(ids, dim):
        return sorted({v for b, d, v in blocks if b in ids and d == dim})

    hit = meeting(filters)
    if hit:
        out = {}
        for dim in {d for b, d, _ in blocks if b in hit}:
            got = values(hit, dim)
            if dim in filters:
                got = [v for v in got if v in (*truth_aliases(filters[dim]), filters[dim])]
                got = ([v for v in got if v in ("0", "1")] or got)[:1]
            out[dim] = got
        return {"": (len(hit), out)}
    out = {}
    for dim in filters:
        rest = meeting({d: v for d, v in filters.items() if d != dim})
        if rest:
            out[dim] = (len(rest), {dim: values(rest, dim)})
    return out


def test_covers_equal_sets_of_blocks(spark):
    rng = random.Random(6)
    blocks = sorted({(f"b{rng.randrange(150)}", d, rng.choice(SPELLED if d == "flag" else [str(i) for i in range(6)])) for d in ("flag", "size", "mode", "rare") for _ in range(220 if d != "rare" else 5)})
    asked = {r: {d: rng.choice(SPELLED if d == "flag" else [str(i) for i in range(7)]) for d in rng.sample(["flag", "size", "mode", "rare", "none"], rng.randrange(1, 4))} for r in range(120)}
    asked[500] = {"flag": "  TRUE "}
    asked[501] = {"none": "1"}
    rows = [(r, d, v) for r, f in asked.items() for d, v in f.items()]
    got = {}
    for r in postings.covers(spark.createDataFrame(blocks, "block_id string, dim string, value string"), spark.createDataFrame(rows, "request long, dim string, value string")).collect():
        got.setdefault(r.request, {}).setdefault(r.dropped, (r.blocks, {}))[1][r.dim] = r["values"]
    assert got == {r: found for r, f in asked.items() if (found := brute(blocks, f))}
    assert got[501] == {"none": (len({b for b, _, _ in blocks}), {"none": []})}


def test_empty_blocks_cover_nothing(spark):
    asked = spark.createDataFrame([(1, "a", "1"), (2, "a", "1"), (2, "b", "1")], "request long, dim string, value string")
    blocks = spark.createDataFrame([], "block_id string, dim string, value string")
    assert postings.covers(blocks, asked).collect() == [] and postings.covers(blocks, asked.limit(0)).collect() == []


def test_a_flag_is_pinned_in_its_stored_spelling(spark):
    blocks = spark.createDataFrame([(1, "flag", "1"), (1, "flag", "0"), (1, "size", "3"), (2, "flag", "false")], "block_id long, dim string, value string")
    for said in ("true", "1", "TRUE", "True"):
        assert {r.dim: r["values"] for r in postings.cover(blocks, {"flag": said}).collect()} == {"flag": ["1"], "size": ["3"]}
    assert {r.dim: r["values"] for r in postings.cover(blocks, {}).collect()} == {"flag": ["0", "1", "false"], "size": ["3"]}


def test_a_lone_filter_is_near_all_values_of_its_dim(spark):
    dims = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "b", "z")], "key_id long, dim string, value string")
    assert [tuple(r) for r in postings.nearby(dims, {"a": "q"}).collect()] == [("a", 0, ["x", "y"])]
    assert {tuple(r)[:2] for r in postings.nearby(dims, {"a": "q", "b": "z"}).collect()} == {("a", 1)}


def test_text_postings_hold_every_gram_of_any_alphabet():
    """Also where characters and lines are too many for one number, and where lines come in several batches."""
    import random
    from collections import defaultdict

    import pyarrow as pa

    from quern.operators import gramindex

    rng = random.Random(5)
    wide = ["".join(chr(rng.randrange(0x3400, 0xD000)) for _ in range(3)) for _ in range(66_000)]
    plain = ["".join(rng.choice("abé😀 ") for _ in range(rng.randrange(3, 9))) for _ in range(3_000)]
    for texts in (wide, plain):
        place = [(f"f{i % 3}", i * 7 % len(texts)) for i in range(len(texts))]
        batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in place]), pa.array([n for _, n in place], pa.int32()), pa.array(texts)], ["path", "line", "text"])
        want, got = defaultdict(set), defaultdict(list)
        for (path, line), text in zip(place, texts, strict=True):
            for i in range(len(text) - 2):
                want[text[i : i + 3], path, line // gramindex.BLOCK].add(line)
        for out in gramindex._posted(iter([batch.slice(0, 5), batch.slice(5)])):
            for r in out.to_pylist():
                got[r["gram"], r["path"], r["block"]] += r["lines"]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
