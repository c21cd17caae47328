"""Macro expansion: the examples of the C standard, and equality with one text at a time."""

import random

from quern.functions.macros import definition, expanded
from quern.operators import macros


def table(text):
    return {d[0]: d[1:] for line in text.strip().split("\n") if (d := definition(line))}


def words(text):
    return "".join(text.split())


STANDARD = """
#define x 3
#define f(a) f(x * (a))
#define g f
#define z z[0]
#define h g(~
#define m(a) a(w)
#define w 0,1
#define t(a) a
#define p() int
#define q(x) x
#define r(x,y) x ## y
#define str(x) # x
"""


def test_examples_of_the_standard():
    d = table(STANDARD.replace("#define x 3", "#define x 2"))
    # x is 2 where the examples are read; f keeps the x of its definition's place in the text.
    cases = {
        "f(y+1) + f(f(z)) % t(t(g)(0) + t)(1);": "f(2 * (y+1)) + f(2 * (f(2 * (z[0])))) % f(2 * (0)) + t(1);",
        "g(x+(3,4)-w) | h 5) & m(f)^m(m);": "f(2 * (2+(3,4)-0,1)) | f(2 * (~ 5)) & f(2 * (0,1))^m(0,1);",
        "p() i[q()] = { q(1), r(2,3), r(4,), r(,5), r(,) };": "int i[] = { 1, 23, 4, 5,  };",
        'char c[2][6] = { str(hello), str() };': 'char c[2][6] = { "hello", "" };',
    }
    for text, expected in cases.items():
        assert words(expanded(text, d)) == words(expected)


def test_pasting_quoting_and_variable_arguments():
    d = table("""
#define cat(a,b) a ## b
#define xcat(x,y) cat(x,y)
#define show(...) puts(#__VA_ARGS__)
#define report(test, ...) ((test) ? puts(#test) : printf(__VA_ARGS__))
#define LOW 1
""")
    assert words(expanded("xcat(xcat(1, 2), 3)", d)) == "123"
    assert expanded("show(The first, second, and third items.);", d) == 'puts("The first, second, and third items.");'
    assert words(expanded('report(x>y, "x is %d", LOW);', d)) == words('((x>y) ? puts("x>y") : printf("x is %d", 1));')
    assert expanded('LOW "LOW" LOWER cat(LOW, LOW) report', d) == '1 "LOW" LOWER LOWLOW report'
    assert expanded("cat(a)", d) == "cat(a)" and expanded("cat(a, b", d) == "cat(a, b" and expanded("", d) == ""


def test_recursion_ends_and_growth_is_bounded():
    d = table("#define a b\n#define b a c\n#define c (c)\n#define two(x) x x\n")
    assert expanded("a b c", d) == "a (c) b (c) (c)"
    deep = "y"
    for _ in range(40):
        deep = f"two({deep})"
    assert expanded(deep, d, most=5000) is None and expanded("two(y)", d, most=5000) == "y y"


def test_lines_are_expanded_with_what_they_can_meet(spark):
    rng = random.Random(8)
    lines = [("m", i, f"#define M{i} M{rng.randrange(30)} + {i}") for i in range(30)]
    lines += [("m", 100 + i, f"#define F{i}(a, ...) (a M{rng.randrange(30)} F{rng.randrange(10)}(__VA_ARGS__))") for i in range(10)]
    lines += [("z", 1, "#define M1 other"), ("z", 2, "#define"), ("z", 3, "  # define BARE")]
    lines += [("s", i, f"x = F{rng.randrange(12)}(M{rng.randrange(33)}, q{i}) + M{rng.randrange(33)} BARE;") for i in range(200)] + [("s", 500, "nothing here"), ("s", 501, "")]
    frame = spark.createDataFrame(lines, "path string, line int, text string").repartition(3)
    own = {}
    for _, _, text in sorted(lines, key=lambda r: r[:2]):
        if d := definition(text):
            own.setdefault(d[0], d[1:])
    assert {r.name for r in macros.definitions(frame).collect()} == set(own)
    got = {(r.path, r.line): r.text for r in macros.expand(frame.where("path = 's'"), ["path", "line"], macros.definitions(frame)).collect()}
    assert got == {(p, i): expanded(t, own) for p, i, t in lines if p == "s"}
    assert macros.expand(frame.limit(0), ["path", "line"], macros.definitions(frame)).count() == 0
    assert macros.expand(frame.where("path = 's'"), ["path", "line"], macros.definitions(frame.limit(0))).where("text LIKE 'x = F%'").count() == 200
