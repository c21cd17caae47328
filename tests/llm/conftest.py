import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeats, near copies and shared passages."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 45)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("w1 ", "x ", 1), "en", None), (4, None, "en", "a"), (5, "", "fr", "a"), (6, " \t\n", None, "b"),
        (7, "one two three", "en", "c"), (8, "ONE two  three", "fr", "c"), (9, words(rng, 60) + " " + passage + " " + words(rng, 30), "en", "a"),
        (10, passage + "\n" + words(rng, 80), "fr", "a"), (11, "é ü ß " * 40, "fr", "b"), (12, words(rng, 4000, 50), "en", "b"), (None, base, "en", "a"), (None, None, None, None),
        (13, "x" * 5000, "en", "a"), (14, base, "en", "b"), (14, base, "en", "b"), (15, "a\n\nb", "en", "b"), (16, "1234 !!", "en", "b"),
    ]
    rows += [(100 + i, " ".join(w if rng.random() > 0.02 else "z" for w in base.split()), "en", "a") for i in range(12)]
    rows += [(200 + i, words(rng, rng.randrange(1, 90), 30), "fr", f"s{i % 4}") for i in range(25)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """Extra columns under names that operators use for their own."""
    extra = "h long, c long, id long, comp long, spans string, size long, shard int, slot long, sub int, at int, n int, key string, kept boolean, unit long, x double, src int"
    own = ("n_words", "spans", "items", "hit", "unit", "size", "rank", "low", "more", "again", "key", "hash", "slot_key", "slot_shard", "doc", "copies")
    extra += "".join(f", _{n} string" for n in own)
    rows = [(*r, *([None] * 16), *("own" for _ in own)) for r in odd_rows if r[0] is not None]
    return spark.createDataFrame(rows, f"{COLUMNS}, {extra}")
