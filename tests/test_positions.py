"""Places in groups that no task holds whole, against a sort of every group."""

import random

from quern.operators import rank


def test_positions_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{rng.randrange(5)}", i % 2, rng.randrange(50), i) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, h int, a int, b int").repartition(7)
    got = {(r.g, r.h, r.a, r.b): r.position for r in rank.positions(frame, ["g", "h"], ["a", "b"]).collect()}
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: r[2:]):
        seen[r[:2]] = want[r] = seen.get(r[:2], 0) + 1
    assert got == want
    assert rank.positions(frame.limit(0), ["g"], ["a"]).isEmpty()
