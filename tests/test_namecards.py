"""Name cards against a scan of all symbols per name."""

import random

from quern.operators import namecards

SYMBOLS, EDGES, ASKED = "id string, name string, kind string, file string, line_start int", "kind string, src string, dst string, n_sites long", "request string, name string"


def looked_up(name, symbols):
    """(stage, {id: owners shared}) by trying every stage on every symbol."""
    if not name:
        return "none", {}
    cut = lambda x: x.lower().replace(".", "::").split("::")
    q, want = name.lower(), cut(name)
    known = [(s[0], s[1].lower(), cut(s[1])) for s in symbols if s[1] is not None]

    def shared(own):
        n = 0
        for a, b in zip(reversed(want[:-1]), reversed(own[:-1])):
            if a != b:
                break
            n += 1
        return n

    same = [(i, low, own) for i, low, own in known if own[-1] == want[-1]]
    for stage, hits in (
        ("exact", {i: shared(own) for i, low, own in same if low == q}), ("owner", {i: shared(own) for i, low, own in same}),
        ("prefix", {i: 0 for i, low, own in known if low.startswith(q) or own[-1].startswith(q)}), ("recall", {i: 0 for i, low, _ in known if q in low}),
    ):
        if hits:
            return stage, hits
    return "none", {}


def test_cards_equal_a_scan_per_name(spark):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    owners = ["", "A::", "B::", "A::B::", "b::A::", "C::A::B::"]
    symbols = [(f"s{i:03}", None if i % 50 == 0 else some(*owners) + some("run", "Run", "runner", "é", "go") + some("", "", str(rng.randrange(12))), "FUNCTION", "f", i) for i in range(300)]
    names = [some(*owners, "Z::", "Z::A::B::") + some("run", "RUN", "runn", "un", "u", "é", "o1", "Run1", "nne", "nothing", "B::r") + some("", "", str(rng.randrange(12))) for _ in range(400)]
    names += [None, "", "a::b", "::", "r", "C::A", "nner1", "*", "1"]
    edges = [(some("CALLS", "READS", "WRITES"), f"s{rng.randrange(300):03}", f"s{rng.randrange(300):03}", rng.randrange(1, 4)) for _ in range(600)]
    edges = list({e[:3]: e for e in edges}.values())
    asked = [(f"r{i}", n) for i, n in enumerate(names)]
    got = namecards.cards(spark.createDataFrame(asked, ASKED), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)).collect()
    assert len(got) == len(asked)
    seen = set()
    for g in got:
        stage, hits = looked_up(g.name, symbols)
        seen.add(stage)
        assert (g.stage, g.hits) == (stage, len(hits)), (g, stage, hits)
        if not hits:
            assert g.id is None and not g.ambiguous
            continue
        best = max(hits.values())
        first = sorted(i for i, n in hits.items() if n == best)
        assert (g.id, g.ambiguous) == (first[0], len(first) > 1), (g, hits)
        into, out = [e for e in edges if e[2] == g.id], [e for e in edges if e[1] == g.id]
        count = lambda rows, kind: sum(e[0] == kind for e in rows)
        assert (g.callers, g.writers, g.readers, g.callees) == (count(into, "CALLS"), count(into, "WRITES"), count(into, "READS"), count(out, "CALLS"))
        callers = sorted((-e[3], e[1]) for e in into if e[0] == "CALLS")
        assert g.top_caller == (callers[0][1] if callers else None)
    assert seen == {"exact", "owner", "prefix", "recall", "none"}


def test_no_symbols(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert [r.stage for r in namecards.cards(spark.createDataFrame([("r", "x")], ASKED), none(SYMBOLS), none(EDGES)).collect()] == ["none"]
    assert namecards.cards(none(ASKED), none(SYMBOLS), none(EDGES)).isEmpty()
