"""Filter audit, vector codes and the factorisation machine against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import factormachine, filteraudit, veccodes

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """The letters that each row (doc_id, text) fails."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        w = t.encode().split()
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append(f + "E" * (doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u in rows)))
    return out


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    fails = failing([r[:2] for r in rows])
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                left = [r for r in own if not set(order[: step - 1]) & set(r[1])]
                gone = [d for d, f in left if x in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), redundant, sum(f == x for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark, odd, odd_rows, nothing, clashing):
    rng = random.Random(3)
    shout = [(300 + i, "LOUD # words " * rng.randrange(1, 60), "en", "a", 0) for i in range(20)]
    rows = odd_rows + shout
    docs = spark.createDataFrame(rows, odd.schema).repartition(5)
    marks = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (14, 1, None), (301, None, 1), (302, 1, 0), (302, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(marks, LABELS)
    assert audited(docs, labels) == brute_audit([r[:3] for r in rows], [m for m in marks if m[0] is not None])
    assert audited(nothing, labels) == {}
    assert len(audited(docs, labels.limit(0))) == 600 * len({r[2] or "" for r in rows})
    kept = [r for r in odd_rows if r[0] is not None]
    assert audited(clashing, labels) == brute_audit([r[:3] for r in kept], [m for m in marks if m[0] is not None])
    text_ids = docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    assert audited(text_ids, labels.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 6, "0"))) == audited(docs, labels)


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_copies_over_many_ranges_and_batches(spark, batch):
    """One text in most rows: its group crosses range and batch borders; one id repeats."""
    rng = random.Random(int(batch))
    rows = [(i, "the same text" if rng.random() < 0.7 else f"text {rng.randrange(30)}" if rng.random() < 0.5 else None, "en") for i in range(300)]
    rows += [(5, "the same text", "fr")] * 40 + [(None, "the same text", "en")] * 30
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(own, ("13", batch, "false"), strict=True):
            spark.conf.set(k, v)
        found = filteraudit.failures(docs)
        got = Counter((r.doc_id, r.part, r.mask >= 16) for r in found.collect())
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert got == Counter((r[0], r[2], "E" in f) for r, f in zip(rows, failing([r[:2] for r in rows]), strict=True))


def test_colliding_fingerprints_are_told_apart():
    """Equal fingerprints, two texts: only equal texts count, also across ranges."""
    import pyarrow as pa

    def batch(rows):
        text, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([7] * len(rows), pa.int64()), pa.array(text), pa.array(ids, pa.int64()), pa.array(["p"] * len(rows)), pa.array([0] * len(rows), pa.int32())], ["fp", "text", "doc_id", "part", "mask"])

    run = filteraudit._compared(pa.int64())
    out = [r for b in run(iter([batch([("a", 1), ("a", 2)]), batch([("a", 3), ("b", 1)]), batch([("b", 4)])])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["again"]) for r in out if r["mask"] is not None] == [(1, False), (2, True), (3, True), (1, False), (4, True)]
    assert {(r["digest"], r["doc_id"]) for r in out if r["mask"] is None} == {(hashlib.sha256(t).digest(), 1) for t in (b"a", b"b")}


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    size = Counter(len(v) for _, v, _ in kept)
    length = max(size, key=lambda d: (size[d], d))
    kept = [r for r in kept if len(r[1]) == length]
    cut = [p * length // parts for p in range(parts + 1)]
    least = {}
    for i, v, _ in kept:
        least[i] = min(least.get(i, v), v)
    first = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for a, b in zip(cut, cut[1:], strict=False):
        book, own = [least[i][a:b] for i in first], [v[a:b] for _, v, _ in kept]
        near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), j) for j, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            groups = defaultdict(list)
            for x in own:
                groups[near(x)[1]].append(x)
            book = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else e for j, e in enumerate(book)]
        for k, x in enumerate(own):
            d, j = near(x)
            codes[k].append(f"{j:02x}")
            errors[k] += d
        books.append(book)
    by = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(c), e, by[lab], sha) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("length, n", [(32, 150), (64, 40), (20, 90), (7, 30)])
def test_codes_equal_brute_force(spark, length, n):
    rng = random.Random(length)
    vector = lambda: [rng.choice((rng.uniform(-1, 1), rng.randrange(-3, 3) / 8, -0.00001)) for _ in range(length)]
    rows = [(i * 3 % n, vector(), rng.choice((0, 1, None))) for i in range(n)]
    hot = vector()
    rows += [(1000 + i, hot, 5) for i in range(n)] + [rows[0], rows[0]] + [(2, vector(), 1), (None, vector(), 1), (None, None, 1)]
    rows += [(5000, None, 0), (5001, [], 0), (5002, [None] * length, 0), (5003, [float("nan")] * length, 0), (5004, [1.0] * (length - 1) + [float("-inf")], 0), (5005, [1.0] * (length + 1), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("_heavy", F.lit(True))
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in veccodes.digest(frame.repartition(4)).collect())
    assert got == brute_codes(rows)


def test_codes_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5] * 16, "a"), (2, None, "b"), (3, [1e30] * 16, None)], "vec_id long, embedding array<float>, label string")
    rows = {r.vec_id: r for r in veccodes.digest(frame).collect()}
    assert set(rows) == {1, 3} and rows[1].code == "00" * 16 and rows[3].code == "01" * 16 and rows[3].error == 0
    assert veccodes.digest(frame.limit(0)).collect() == []
    assert veccodes.digest(frame.where("vec_id = 2")).collect() == []


def test_light_and_heavy_keys_join_alike(spark):
    rng = random.Random(9)
    keys = [None, *range(3000)]
    rows = [(rng.choice((1, 1, None, *keys[2:])), i) for i in range(6000)]
    left = spark.createDataFrame(rows, "k int, i int")
    unique = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    got = Counter(map(tuple, veccodes.join_weighted(left, unique, ["k"], "n", len(rows), ["s"]).collect()))
    sums = Counter()
    for k, i in rows:
        sums[k] += i
    assert got == Counter((k, i, sums[k]) for k, i in rows)


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = factormachine.Machine(np.sort(rng.normal(size=(len(factormachine.STATISTICS), len(factormachine.QUANTILES))), axis=1), 0.3, rng.normal(size=factormachine.WIDTH), rng.normal(size=(factormachine.WIDTH, 3)))
    x = factormachine.extract(["one two two three", "", None, "ÄÖ 12!! LOUD\nLOUD", "one two " * 400], [None, 0, None, -4, 9])
    ptr, place, value = factormachine.with_bins(x, machine.edges)
    raw, _, _ = machine.raw(ptr, place, value)
    for r in range(5):
        at = range(ptr[r], ptr[r + 1])
        pairs = sum(machine.factor[place[i]] @ machine.factor[place[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert np.isclose(raw[r], 0.3 + sum(machine.weight[place[i]] * value[i] for i in at) + pairs)
    label = np.array([1, 0, 1, 0, 1.0])
    g = machine.gradient(x, label)
    loss = lambda m: -np.sum(label * np.log(m.score(x)) + (1 - label) * np.log(1 - m.score(x)))
    for i in (0, 1 + 4 * int(place[2]), 3 + 4 * int(place[2]), len(g) - 1):
        moved = np.concatenate([[machine.bias], np.concatenate([machine.weight[:, None], machine.factor], axis=1).ravel()])
        moved[i] += 1e-5
        table = moved[1:].reshape(-1, 4)
        assert np.isclose((loss(factormachine.Machine(machine.edges, moved[0], table[:, 0], table[:, 1:])) - loss(machine)) / 1e-5, g[i], atol=1e-3)


def test_extracting_alone_or_in_a_batch_is_the_same():
    texts = ["a b c", "", "x" * 300_000, None, "a a b\nB"]
    whole = factormachine.extract(texts, [None] * 5)
    for i, t in enumerate(texts):
        one = factormachine.extract([t], [None])
        a, b = whole.ptr[i], whole.ptr[i + 1]
        assert (one.place == whole.place[a:b]).all() and np.allclose(one.value, whole.value[a:b]) and np.allclose(one.stats[0], whole.stats[i])


def test_machine_on_odd_tables(spark, odd, odd_rows, nothing, clashing):
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") > 300), 0) for r in odd_rows if r[0] != 14] + [(None, 1, 1), (7, None, 0)], LABELS)
    out = factormachine.cross_checked(odd, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    assert factormachine.cross_checked(nothing, labels).collect() == []
    none = factormachine.cross_checked(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    plain = factormachine.cross_checked(odd.drop("n_chars", "lang", "source").withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert plain.count() == len(odd_rows)
    assert factormachine.cross_checked(clashing, labels).count() == clashing.count()


def test_machine_on_held_out_rows(spark):
    from quern.llm.queries import op13_factorisation_machine

    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op13_factorisation_machine(spark, sf).collect() if r.held_out and r.doc_id in quality]
    right = {q: [r.predicted == q for r in rows if quality[r.doc_id] == q] for q in (0, 1)}
    assert len(rows) > 50 and all(np.mean(v) >= 0.95 for v in right.values())
