import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import linededup, minhash, rlz, runindex
from quern.llm.words import as_bytes


def shingles(text):
    w = as_bytes(text).lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_minhash_matches_brute_force(odd, odd_rows):
    expected = brute_components([r for r in odd_rows if r[0] is not None])
    got = minhash.digest(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)


def test_minhash_dense_group_loses_no_link(spark):
    """Variants of one text around the threshold, in lists long enough to be compared in blocks."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"v{rng.integers(9)}" for w in base)) for i in range(150)]
    expected = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_minhash_dense_group_in_several_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SUB_BLOCK", 40)
    test_minhash_dense_group_loses_no_link(spark)


def test_rows_that_share_an_id_have_their_own_links(spark):
    rng = np.random.default_rng(9)
    a, b = (" ".join(f"w{rng.integers(10**6)}" for _ in range(40)) for _ in range(2))
    rows = [(5, a), (5, b), (3, b + " x"), (7, a), (7, a)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.digest(frame).collect()) == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False)]
        assert sorted(map(tuple, minhash.keep_one(frame).collect())) == sorted([(3, b + " x"), (5, a)])


def test_minhash_takes_ids_of_any_type(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None)]
    got = minhash.digest(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_keep_one_keeps_columns_and_one_row_each(odd, clashing, nothing):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[14] == 0 and ids[1] == 1 and ids[4] == 1 and ids[None] == 2
    assert minhash.keep_one(clashing).columns == clashing.columns
    assert minhash.digest(nothing).count() == 0


def test_blocks_count_common_shingles():
    rng = np.random.default_rng(1)
    one, two = ([np.unique(rng.integers(0, 90, 50).astype(np.uint64)) for _ in range(5)] for _ in range(2))
    got = minhash.common_counts(one, two, width=7)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in two] for a in one]


def brute_bytes(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_run_index_matches_brute_force(odd, odd_rows):
    expected = Counter((r[0], *x) for r, x in zip(odd_rows, brute_bytes([as_bytes(r[1]) for r in odd_rows], 200), strict=True))
    assert Counter(tuple(r) for r in runindex.digest(odd).collect()) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30).map(str.encode), min_size=1, max_size=6), st.integers(1, 6))
def test_run_index_marks_every_long_match(strings, least):
    strings = [s for s in strings if s] or [b"a"]
    index = runindex.RunIndex(strings)
    found = index.long_matches(least)
    joined = [x for i, s in enumerate(strings) for x in [*(b + len(strings) for b in s), i]]
    order = sorted(range(len(joined)), key=lambda i: joined[i:])
    assert np.repeat(index.run_symbols, index.run_lengths).tolist() == [joined[i - 1] for i in order]
    seen = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
    for s, spans in zip(strings, found, strict=True):
        marked = {i for a, b in spans for i in range(a, b)}
        assert marked == {i + k for i in range(len(s) - least + 1) if seen[s[i : i + least]] > 1 for k in range(least)}


def test_rlz_matches_brute_force(odd, odd_rows):
    order = sorted(range(len(odd_rows)), key=lambda i: (odd_rows[i][0] is not None, odd_rows[i][0] or 0))
    seen, expected = {}, Counter()
    for i in order:
        key, w = odd_rows[i][0], as_bytes(odd_rows[i][1]).split()
        gone = set()
        for s in range(len(w) - 19):
            place = (key if key is not None else -1, s)
            first = seen.setdefault(tuple(w[s : s + 20]), place)
            if first < place:
                gone.update(range(s, s + 20))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expected[(key, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in rlz.digest(odd).collect()) == expected


def test_rlz_keeps_the_first_holder_in_repeated_rows(spark):
    """A repeated row holds a passage first, in other contexts than the later row."""
    rng = np.random.default_rng(11)
    side = lambda k: " ".join(f"{k}{rng.integers(10**6)}" for _ in range(30))
    passage = " ".join(f"p{i}" for i in range(50))
    first, later = f"{side('a')} {passage} {side('b')}", f"{side('c')} {passage} {side('d')}"
    frame = spark.createDataFrame([(1, first), (1, first), (2, later)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in rlz.digest(frame).collect()) == [(1, 0), (1, 0), (2, 50)]


@pytest.mark.parametrize("digest", [runindex.digest, rlz.digest])
def test_substring_dedup_of_odd_tables(digest, nothing, clashing):
    assert digest(nothing).count() == 0
    assert digest(clashing).count() == clashing.count()


def brute_words(rows, window=20):
    """n_removed per row in order of ids, all different."""
    seen, out = {}, []
    for i, text in sorted(rows):
        w, gone = text.split(), set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), (i, s)) < (i, s):
                gone.update(range(s, s + window))
        out.append(len(gone))
    return out


@pytest.mark.parametrize("limit", [1, 3, None])
def test_hot_anchors_are_cut_in_halves(spark, monkeypatch, limit):
    """Passages whose edges have more contexts than a block may hold, at small limits and at the real one."""
    from quern.llm import anchors

    if limit:
        monkeypatch.setattr(anchors, "MOST_CONTEXTS", limit)
    rng = np.random.default_rng(7)
    passage = [f"p{i}" for i in range(60)]
    side = lambda: [f"r{rng.integers(10**6)}" for _ in range(25)]
    rows = []
    for i in range(320 if limit is None else 24):
        cut = int(rng.integers(0, 12))
        rows.append((i, " ".join(side() + passage[cut : 60 - int(rng.integers(0, 12))] + ["odd", "even"][i % 2 : i % 2 + 1] * (i % 3) + side())))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in rlz.digest(frame).orderBy("doc_id").collect()] == brute_words(rows)
    expected = brute_bytes([t.encode() for _, t in rows], 200)
    assert [tuple(r)[1:] for r in runindex.digest(frame).orderBy("doc_id").collect()] == expected


def test_line_dedup(spark, nothing, clashing):
    line = "This Line is Found in Many Documents of the table"
    rows = [(i, f"{'É' if i % 2 else 'x'}{i}\n  {line.upper() if i == 3 else line}\t\nend", None) for i in range(6)] + [(7, None, None), (8, "", None), (9, "é" * 40, None), (None, line, None)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, at int")).collect()}
    assert [got[i].n_dropped for i in range(6)] == [1, 1, 1, 1, 1, 0] and got[None].n_dropped == 1
    assert got[3].text == "É3\nend" and got[5].text.count("\n") == 2
    assert (got[7].n_lines, got[7].text, got[8].n_lines) == (1, "", 1)
    assert linededup.dedup_lines(nothing).count() == 0
    assert linededup.dedup_lines(clashing).count() == clashing.count()


@pytest.mark.parametrize("other", ["", "\nand more"])
def test_line_dedup_counts_a_document_once(spark, other):
    """Four documents, one of them in two rows, in one batch or in two."""
    line = "this line stands in four documents and no more of them"
    one, two = ([(i, t) for i in ids] for ids, t in (((1, 2, 3, 4), line), ((2,), line + other)))
    whole, *parts = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (one + two, one, two))
    for batches in (None, parts):
        assert [r.n_dropped for r in linededup.dedup_lines(whole, batches).collect()] == [0] * 5
        assert sorted(r.n_dropped for r in linededup.dedup_lines(whole, batches, min_docs=4).collect()) == [0, 1, 1, 1, 1]


def test_line_runs_levels_and_fresh_lines(spark):
    runs = linededup.LineRuns(spark, fanout=2, min_chars=1)
    batch = lambda rows: runs.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    for k in range(4):
        runs.add(batch([(k, f"line {k}\nshared")]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    runs.add(batch([(3, "shared\nline 3"), (3, "shared")]))
    assert spark.table(runs.runs()[0]).count() == 0
    fresh = runs.fresh(batch([(9, "shared\nnew"), (3, "shared")]).select(*linededup.KEYS))
    assert fresh.count() == 2
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
    assert [r.max_doc for r in runs.frequent(4).collect()] == [3]
    runs.close()


@pytest.mark.parametrize("n_batches", [1, 2, 7])
def test_line_dedup_does_not_depend_on_batches(spark, n_batches):
    """Against brute force, with ids that have several texts and rows repeated."""
    rng = np.random.default_rng(5)
    pool = [f"line number {i} is long enough to count as a long line" for i in range(30)]
    rows = [(int(rng.integers(25)), "\n".join(pool[k] for k in rng.integers(0, 30, 3))) for _ in range(60)]
    rows += rows[:15]
    holders = {x: {d for d, t in rows if x in t.split("\n")} for x in pool}
    gone = {x: max(h) for x, h in holders.items() if len(h) >= 5}
    expected = Counter((d, "\n".join(x for x in t.split("\n") if gone.get(x, d) == d)) for d, t in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(frame, n_batches=n_batches).collect()) == expected


def test_fold_ascii_folds_only_ascii(spark):
    from pyspark.sql import functions as F

    texts = ["Abc", "aBC", "É a", "é A", "ÉA", "Ã©", "ã©", "Ðx", "ðx", "日本A", "日本a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.fold_ascii(F.col("t")).alias("k")).collect()
    fold = lambda t: t.encode().lower()
    for a in rows:
        for b in rows:
            assert (a.k == b.k) == (fold(a.t) == fold(b.t)), (a, b)
