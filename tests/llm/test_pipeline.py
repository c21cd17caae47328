import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, tmp_path, odd, odd_rows):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    assert not seen[0] & {4, 5, 6, 7} and 1 in seen[0]
    assert 2 not in seen[1] and 14 not in seen[1] and 1 in seen[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_first_stages_match_brute_force(spark, tmp_path, odd, odd_rows):
    """Rows after the quality, near-dedup and decontamination stages, judged one by one."""
    from collections import Counter

    from test_dedup import shingles
    from test_texts import brute_quality

    item = " ".join(odd_rows[8][1].split()[10:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")

    def good(text):
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 2 * n <= chars <= 15 * n and 10 * dup <= 3 * len(lines)

    kept = [r for r in odd_rows if good(r[1])]
    sets = [shingles(r[1]) for r in kept]
    root = list(range(len(kept)))
    for _ in kept:  # smallest (id, text) that each row reaches, by repeated lowering
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if kept[i][0] is not None and kept[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = min(root[i], root[j], key=lambda k: kept[k][0] if kept[k][0] is not None else 10**9)
    firsts = {kept[root[i]][0] for i in range(len(kept)) if kept[i][0] is not None}
    single = {r[0]: r for r in kept if r[0] in firsts}
    rest = [*single.values(), *(r for r in kept if r[0] is None)]

    def words(text):
        return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()

    grams = {tuple(words(item)[i : i + 13]) for i in range(len(words(item)) - 12)}

    def contaminated(text):
        w = words(text)
        hit = {i + k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in grams for k in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    expected = [kept, rest, [r for r in rest if not contaminated(r[1])]]
    assert len(expected[2]) < len(expected[1]) < len(expected[0]) < len(odd_rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES, expected, strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in rows), name
