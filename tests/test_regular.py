"""The way without Python workers against the matcher, on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.grammar import library
from spanweave.grammar.program import compiled
from spanweave.operators import regular, spans
from spanweave.operators.parse import parse_documents

LEXER = r"""
text = (number / name / quoted / comment / .)* {
  number = @number("-"? [0-9]+ !"x")
  name = @name([a-z] [a-z0-9]*)
  quoted = "\"" @inside([^"]+) "\""
  comment = "#" @comment((word / [^a-z\n])+)
  word = @word([a-z]+)
}
"""


@pytest.mark.parametrize("program", [library.program("lines"), library.program("tags"), compiled(LEXER)])
def test_literals_are_the_matchers(spark, program):
    rng = random.Random(1)
    alphabet = "ab9z-x<>/!- \n#\"\"éÄ😀\t&"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)] + [(900, None), (901, "<!-- x --> <b><i>" * 3000), (902, "a " * 50_000), (903, "#" + "a1" * 50_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    own = regular.loop(program)
    assert own is not None
    parsed = spans.captures(parse_documents(docs, program, "text", ["id", "text"]), ["id"], None, "text")
    want = {}
    for r in parsed.collect():
        want.setdefault((r.id, r.kind), []).append(r.literal)
    for kind in own.kinds():
        got = regular.found(docs, program, "text", kind, ["id"])
        assert "InArrow" not in got._jdf.queryExecution().toString()
        for r in got.collect():
            assert r.literals == want.get((r.id, kind), []), (kind, rows[r.id][1] if r.id < 900 else r.id)


@pytest.mark.parametrize("source", ["a = b* { b = 'x' }", "a = ('(' a ')' / .)* { }", "a = (@k('x') @k('y') / .)* {}", "a = (@k('x'*) 'y' / .)* {}", "a = (@k .)*^ {}"])
def test_other_shapes_go_to_the_matcher(spark, source):
    program = compiled(source)
    assert regular.loop(program) is None
    docs = spark.createDataFrame([(1, "xyxx")], "id long, text string")
    assert regular.found(docs, program, "text", "k", ["id"]).count() == 1


def test_binary_columns_go_to_the_matcher(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab \xff cd"))], "id long, text binary")
    got = regular.found(docs, library.program("lines"), "text", "word", ["id"])
    assert "InArrow" in got._jdf.queryExecution().toString() and got.first().literals == ["ab", "\ufffd", "cd"]  # malformed bytes are recovered wherever a character is asked for


def test_edits_outside_are_refused(spark):
    from spanweave.operators import edits

    docs = spark.createDataFrame([(1, "héllo"), (2, "ab"), (3, None), (4, "x")], "id long, text string")
    rows = [(1, 1, 1, 3, "e"), (1, 2, None, None, "!"), (2, 1, 0, 1, "z"), (2, 2, 1, 9, "no"), (2, 3, 0, 0, "never"), (3, 1, None, None, "new"), (4, 1, 1, 0, "no")]
    todo = spark.createDataFrame(rows, "id long, seq int, start int, old_end int, replacement string")
    got = {r.id: (bytes(r.text).decode(), r.error) for r in edits.apply_edits(docs, todo, "id", "text").collect()}
    assert got == {1: ("hello!", None), 2: ("zb", "edit 2: 1..9 in 2 bytes"), 3: ("new", None), 4: ("x", "edit 1: 1..0 in 1 bytes")}


def test_islands_and_their_diagnostics(spark):
    program = compiled("s = (a / b)*^:outer {\n a = @a('x' 'y' 'z')\n b = ' '\n}")
    docs = spark.createDataFrame([(1, "xyzxy?? xyz?"), (2, "xyz"), (3, "")], "id long, text string")
    parsed = parse_documents(docs, program, "text", ["id"], with_islands=True)
    got = [tuple(r) for r in spans.recovery_spans(parsed, ["id"]).orderBy("id", "span_id").collect()]
    assert got == [(1, 0, 5, 7, 2), (1, 1, 11, 12, 1)]  # a rescue begins where the attempt came to
    rows = spans.recoveries(parsed, ["id"]).orderBy("capture_idx").collect()
    assert [r.start for r in rows] == [5, 6, 11] and all(r.told and r.label == "outer" for r in rows)
    assert [r.rule_stack for r in rows] == [["s"]] * 3  # of the first span, the second attempt came farther
    assert [r.rule_stack for r in spans.notes(parsed, ["id"]).orderBy("capture_index").collect()] == [["s", "a"], ["s"], ["s"]]
    assert spans.orphan_captures(parsed, ["id"]).count() == 0 and spans.orphan_notes(parsed, ["id"]).count() == 0
    made = parsed.withColumn("notes", F.transform("notes", lambda n: n.withField("capture_index", F.lit(0))))
    assert spans.orphan_notes(made, ["id"]).count() == 3
