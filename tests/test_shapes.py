"""Matches shared by documents that a program can't tell apart."""

import random

import pytest

from spanweave.grammar import library
from spanweave.grammar.program import compiled
from spanweave.kernel.matcher import Matcher
from spanweave.kernel.shapes import Shapes
from spanweave.operators.parse import parse_by_grammar
from spanweave.plans import queries


class Counted:
    def __init__(self, matcher):
        self.matcher, self.program, self.n = matcher, matcher.program, 0

    def match(self, data):
        self.n += 1
        return self.matcher.match(data)


@pytest.mark.parametrize("grammar", library.NAMES)
def test_shared_matches_are_those_of_the_matcher(grammar):
    own = Matcher(library.program(grammar))
    shapes = Shapes(own, kept=400)  # so small that matches are forgotten and made again
    dice = random.Random(5)
    texts = [t.replace("#", str(dice.randrange(2000))) for _, t in (*queries._CODE, *queries._MIXED) for _ in range(4)]
    texts += ["", "é", "a é 1", "\t a", " \ta"] + ["".join(dice.choice('ab 01\t\n"{}.é') for _ in range(dice.randrange(9))) for _ in range(150)]
    dice.shuffle(texts)
    for t in texts:
        assert shapes.match(t.encode()) == own.match(t.encode()), t
    for bad in (b"\xff", b'{"k": \xff1}', b'{"k": 1}\x80'):
        assert shapes.match(bad) == own.match(bad)


def test_routed_documents_are_matched_once_a_shape():
    for name, text in (("rust", queries._CODE[6][1]), ("rust", queries._CODE[7][1]), ("sql", queries._MIXED[0][1]), ("json", queries._MIXED[6][1])):
        counted = Counted(Matcher(library.program(name)))
        shapes = Shapes(counted)
        for key in range(100_000, 110_000):
            shapes.match(text.replace("#", str(key)).encode())
        assert counted.n <= 500, (name, counted.n)


def test_columns_literals_and_sets_part_classes():
    table = Shapes(Matcher(compiled('r = ([a-f]+ / "q" / " ")* '))).table
    assert table[ord("a")] == table[ord("f")] != table[ord("g")] == table[ord("z")]
    assert len({table[ord(c)] for c in "aqz "}) == 4


def test_shared_matches_as_rows(spark):
    rows = [(i, ("json", "words")[i % 2], (f'{{"k": {i}}}', f"a {i % 7}é" * (i % 3))[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "id int, g string, t string").coalesce(1)
    registry = {n: library.program(n) for n in ("json", "words")}
    got = {r.id: r for r in parse_by_grammar(docs, registry, "g", "t", ["id"], True, True).collect()}
    own = {n: Matcher(p) for n, p in registry.items()}
    for i, g, t in rows:
        want = own[g].match(t.encode())
        r = got[i]
        assert (r.n_bytes, r.matched, r.complete) == (len(t.encode()), want.matched, want.complete)
        assert [(c.kind, c.start, c.end) for c in r.captures] == want.captures
        assert [n.pos for n in r.notes] == [n.pos for n in want.notes]
        assert r.tiles[-1].end == r.n_bytes if r.n_bytes else not r.tiles
