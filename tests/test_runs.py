"""Grammars of runs: whole arrays against the matcher, and inputs that lie in one part."""

import random
import time

import pyarrow as pa
import pytest

from spanweave.grammar import library
from spanweave.grammar.program import compiled
from spanweave.kernel import runs
from spanweave.kernel.matcher import Matcher
from spanweave.operators import parse

GRAMMARS = {
    "lines": library.program("lines"),
    "words": library.program("words"),
    "nested": compiled(r'r = (block / ";")* { block = @block((word / @digit([0-9]) / odd / " ")+)  word = @word([a-z]+)  odd = @odd((@low([^a-z0-9 ;]))+) }'),
    "deep recovery": compiled(r'r = part { part = item*^  item = @word([a-z]+) / @digit([0-9]) / [ ]+ }'),
}


def _documents(seed):
    dice = random.Random(seed)
    letters = ["a", "b", "Z", "1", "2", " ", "\n", ";", "é", "漢", "😀", "\x80", "\x7f", "\0", "-"]
    docs = ["".join(dice.choice(letters) for _ in range(dice.randrange(14))).encode() for _ in range(300)]
    return docs + [b"", b"", "é".encode(), b"\xc3", b"\xa9", b"ab\xff\xfeb", b"a\xe2\x82", b"\xac b", b"", b"\xed\xa0\x80a", b"a b\nc", b""]


@pytest.mark.parametrize("name", GRAMMARS)
def test_columns_are_those_of_the_matcher(name):
    program = GRAMMARS[name]
    plan, own = runs.plan(program), Matcher(program)
    assert plan is not None
    for seed, kind in ((1, pa.binary()), (2, pa.large_binary())):
        docs = _documents(seed)
        column = pa.array([b"x", *docs], kind).slice(1)
        rows = []
        for a, b, good in parse._valid_parts(column):
            assert all(runs.valid(d) == good for d in docs[a:b])
            if good:
                made = parse._run_columns(plan, column.slice(a, b - a), True, True)
            else:
                made = parse._columns(docs[a:b], [own.match(d) for d in docs[a:b]], True, True)
            rows += zip(*(x.to_pylist() for x in made), strict=True)
        want = list(zip(*(x.to_pylist() for x in parse._written(docs, [own.match(d) for d in docs], True, True)), strict=True))
        for d, r, w in zip(docs, rows, want, strict=True):
            assert r == w, d


def test_other_grammars_have_no_plan():
    others = ['r = "ab"*', 'r = ([a-c] / [b-d]+)*', "r = [a-z]*", "r = @w([a-z]+) / .", 'r = ("(" r ")" / [a-z])*', "r = ([α-ω] / [^α-ω])*"]
    assert all(runs.plan(compiled(x)) is None for x in others)
    assert [n for n in library.NAMES if runs.plan(library.program(n))] == ["lines", "words"]


def test_prose_takes_no_step_a_character():
    docs = ["Some words, and more of them.\n" * 40_000]
    plan = runs.plan(library.program("words"))
    begin = time.process_time()
    parse._run_columns(plan, pa.array([d.encode() for d in docs], pa.binary()), True, True)
    assert time.process_time() - begin < 2  # the matcher takes over 4 s a MB


def test_malformed_documents_among_others(spark):
    docs = [(i, bytearray(d)) for i, d in enumerate(_documents(3))] + [(1000, None)]
    df = spark.createDataFrame(docs, "id int, t binary")
    own = Matcher(GRAMMARS["words"])
    got = {r.id: r for r in parse.parse_documents(df, GRAMMARS["words"], "t", ["id"], True, True).collect()}
    assert len(got) == len(docs)
    for i, d in docs:
        want = own.match(bytes(d or b""))
        assert ([(c.kind, c.start, c.end) for c in got[i].captures], [n.pos for n in got[i].notes]) == (want.captures, [n.pos for n in want.notes])


def test_a_large_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id", "repeat(string(id), 9) AS t").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    monkeypatch.setattr(parse, "PART_BYTES", 1000)
    dealt = parse.spread(one)
    cores = spark.sparkContext.defaultParallelism
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert parse.PARTS[0] * cores < len(sizes) <= parse.PARTS[1] * cores and sum(sizes) == 5000 and max(sizes) < 3 * 5000 / len(sizes) + 20
    assert {r.id for r in dealt.collect()} == set(range(5000))
