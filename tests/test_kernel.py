"""Compiling and matching, and the operators on hand-made documents."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.grammar import library
from spanweave.grammar.analysis import lint
from spanweave.grammar.notation import GrammarError, parse
from spanweave.grammar.program import MalformedProgram, SoftEnd, compiled, decode, encode
from spanweave.kernel.matcher import Matcher
from spanweave.operators import edits, spans
from spanweave.operators.parse import nesting, parse_documents, tiles


def match(source, data):
    return Matcher(compiled(source)).match(data)


def test_json_partial():
    m = Matcher(library.program("json")).match(b'{"k": [1, 2')
    assert (m.matched, m.complete, len(m.captures)) == (11, False, 7)
    assert Matcher(library.program("json")).match(b"").complete is False


def test_left_recursion_is_left_associative():
    m = match('sum = expr { expr = @sum(expr "+" num) / num  num:atomic = @n(\\d+) }', b"1+2+3")
    assert m.complete
    assert m.captures == [("sum", 0, 5), ("sum", 0, 3), ("n", 0, 1), ("n", 2, 3), ("n", 4, 5)]


def test_recovery_and_malformed_bytes():
    m = match("text = item*^ { item = @word([a-z]+) / \\s+ }", b"ab 12 c")
    assert [c for c in m.captures if c[0] == "recovery"] == [("recovery", 3, 4), ("recovery", 4, 5)]
    assert [(n.capture_index, n.pos, n.origin) for n in m.notes] == [(1, 3, "grammar"), (2, 4, "grammar")]
    m = match("text = .*", b"a\xff\xfeb")
    assert m.complete and m.captures == [("recovery", 1, 3)]


def test_sequences_too_long_for_one_expression():
    letters = "[" + "".join(f"\\u{{{x:x}}}" for x in range(0x100, 0x1F4, 2)) + "]"
    m = match(f"text = @x(a) {{ a = {letters} {letters} {letters} 'z' }}", "ĀĂĀz".encode())
    assert m.complete and m.captures == [("x", 0, 7)]


def test_indentation():
    source = "file = %root(block) { block = line (\\R %align line)*  line = @line([a-z]+) }"
    assert match(source, b"ab\ncd").complete
    assert not match(source, b"ab\n cd").complete


def test_encoding():
    for name in library.NAMES:
        p = library.program(name)
        assert encode(decode(encode(p))) == encode(p)
    with pytest.raises(MalformedProgram):
        decode(encode(p)[:-1] + b"x")
    with pytest.raises(GrammarError):
        compiled("a = b")


def test_tiles_cover_everything():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 12)
        found: list = []

        def grow(lo, hi, deep):
            at = lo
            while at <= hi and rng.random() < 0.6 and deep < 4:
                s = rng.randint(at, hi)
                e = rng.randint(s, hi)
                found.append((f"k{rng.randint(0, 3)}", s, e))
                grow(s, e, deep + 1)
                at = e

        grow(0, n, 0)
        # innermost at a byte: the last capture that covers it
        want = [max((i for i, (_, s, e) in enumerate(found) if s <= b < e), default=-1) for b in range(n)]
        got = [i for s, e, _, i in tiles(found, n) for _ in range(s, e)]
        assert got == want
        for i, (depth, parent) in enumerate(nesting(found)):
            over = [j for j in range(i) if found[j][2] > found[i][1]]
            assert (depth, parent) == (len(over), max(over, default=-1))


def test_null_payload_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "ab é\nc"), (3, "")], "id long, t string")
    rows = {r.id: r for r in parse_documents(df, library.program("lines"), "t", ["id"], True).collect()}
    assert (rows[1].n_bytes, rows[1].complete, rows[1].captures) == (0, True, [])
    assert [(c.kind, c.start, c.end, c.depth, c.parent) for c in rows[2].captures] == [("line", 0, 5, 0, -1), ("word", 0, 2, 1, 0), ("line", 6, 7, 0, -1), ("word", 6, 7, 1, 2)]
    with pytest.raises(ValueError):
        parse_documents(df.withColumnRenamed("id", "notes"), library.program("lines"), "t", ["notes"])


def test_islands_and_clusters(spark):
    df = spark.createDataFrame([(1, "ab 12! c"), (2, "é-"), (3, "x")], "id long, t string")
    parsed = parse_documents(df, library.program("words"), "t", ["id"], with_islands=True)
    assert sorted(tuple(r) for r in spans.recovery_spans(parsed, ["id"]).select("id", "start", "end", "n_captures").collect()) == [(1, 3, 6, 3), (2, 0, 3, 2)]
    assert [(r.leaf, r.n) for r in spans.clusters(parsed).collect()] == [("text", 5)]
    assert [(r.leaf, r.n) for r in spans.clusters(parsed, {"text"}).collect()] == [("<empty>", 5)]
    untold = parsed.withColumn("islands", F.transform("islands", lambda i: i.withField("told", F.lit(False))))
    assert spans.orphan_captures(untold, ["id"]).count() == 5
    assert spans.orphan_notes(parsed.withColumn("captures", F.filter("captures", lambda c: F.lit(False))), ["id"]).count() == 5


def test_edits(spark):
    """Ranges outside are refused now, where they were cut to the document before."""
    docs = spark.createDataFrame([(1, "hello"), (2, None), (3, "same")], "id long, t string")
    todo = spark.createDataFrame([(1, 2, 0, 1, "J"), (1, 1, 5, 5, " there"), (2, 1, None, None, "new"), (2, 2, 1, 2, None)], "id long, seq int, start long, old_end long, replacement string")
    got = {r.id: r.t for r in edits.apply_edits(docs, todo, "id", "t").select("id", F.decode("t", "UTF-8").alias("t")).collect()}
    assert got == {1: "Jello there", 2: "nw", 3: "same"}


@pytest.mark.parametrize(
    ("source", "calls"),
    [
        ("s = a 'z' { a = 'x' b  b = 'y'* }", [("b", "a")]),
        ("s = a 'z' { a = 'x' b  b = 'w' c  c = 'y'? }", [("b", "a"), ("c", "b")]),
        ("s = a 'z' { a = 'x' @k(b / 'v')  b = 'w' c  c = 'y'+ }", [("b", "a"), ("c", "b")]),
        ("s = a 'z' { a = 'x' b ';'  b = 'w' c ';'  c = 'y'? }", []),
        ("s = a 'z' { a = 'x' b  b = 'w' c  c = 'y'? &[;z] }", []),
        ("s = a 'z' { a = 'x' b$  b = 'w' c$  c = 'y'? }", []),
        ("s = a 'z' { a = (b)*^[;]  b:atomic = 'y'? }", []),
        ("s = a { a = b / 'q'  b = 'x' a / 'y'* }", [("a", "b"), ("b", "a")]),
    ],
)
def test_lint_follows_calls(source, calls):
    assert [(f.rule, f.caller) for f in lint(parse(source))] == calls
    assert compiled(source)
    if calls:
        with pytest.raises(SoftEnd):
            compiled(source, strict=True)
    else:
        assert compiled(source, strict=True)
