"""Columns that nobody wants are neither built nor moved."""

import numpy as np
import pyarrow as pa
import pytest

from spanweave.grammar import library
from spanweave.kernel import runs
from spanweave.kernel.matcher import Matcher
from spanweave.operators import parse, spans
from spanweave.plans import queries

DOCS = [b"ab 1c\n\nd\xc3\xa9", b"", b"--", b"a b\nc"]


@pytest.mark.parametrize("name", ["lines", "words"])
@pytest.mark.parametrize("only", [["islands"], ["tiles", "n_bytes"], ["captures", "notes"], []])
def test_wanted_columns_are_those_among_all(name, only):
    program = library.program(name)
    plan, own, column = runs.plan(program), Matcher(program), pa.array(DOCS, pa.binary())
    every = dict(zip(parse._new(True, True), parse._run_columns(plan, column, True, True), strict=True))
    want = [every[x].to_pylist() for x in every if x in only]
    assert [x.to_pylist() for x in parse._run_columns(plan, column, True, True, only)] == want
    assert [x.to_pylist() for x in parse._columns(DOCS, [own.match(d) for d in DOCS], True, True, only)] == want


def test_unknown_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    with pytest.raises(ValueError, match="islands"):
        parse.parse_documents(df, library.program("words"), "t", ["id"], only=["islands"])
    assert parse.parse_documents(df, library.program("words"), "t", ["id"], only=["complete", "n_bytes"]).columns == ["id", "n_bytes", "complete"]


@pytest.mark.parametrize(
    ("name", "moved"),
    [
        ("recovery_clusters", ["islands"]),
        ("orphan_checks", ["doc_id", "captures", "notes", "islands"]),
        ("recovery_rows", ["doc_id", "captures", "islands"]),
        ("depth_hist", ["captures"]),
        ("parent_edges", ["captures"]),
        ("tiling_check", ["doc_id", "n_bytes", "tiles"]),
        ("recovery_spans", ["doc_id", "islands"]),
    ],
)
def test_queries_ask_for_what_they_read(spark, monkeypatch, name, moved):
    seen = []
    own = queries.parse_documents
    monkeypatch.setattr(queries, "parse_documents", lambda *a: seen.append(own(*a)) or seen[-1])
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [x.columns for x in seen] == [moved]


def test_captures_are_not_made_anew(spark):
    df = spark.createDataFrame([(1, "ab 1\nc"), (2, "")], "id int, t string")
    found = spans.captures(parse.parse_documents(df, library.program("lines"), "t", ["id"]), ["id"])
    assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert dict(found.dtypes)["capture_idx"] == "int"
    got = [tuple(r) for r in found.orderBy("id", "capture_idx").collect()]
    assert got == [(1, 0, "line", 0, 4, 0, -1), (1, 1, "word", 0, 2, 1, 0), (1, 2, "line", 5, 6, 0, -1), (1, 3, "word", 5, 6, 1, 2)]


def test_tiles_take_no_hash_of_every_edge(monkeypatch):
    monkeypatch.setattr(np, "unique", None)  # it hashes all edges, then sorts them
    program = library.program("lines")
    made = parse._run_columns(runs.plan(program), pa.array(DOCS, pa.binary()), True, False, ["tiles"])[0]
    want = [parse.tiles(Matcher(program).match(d).captures, len(d)) for d in DOCS]
    assert [[tuple(x.values()) for x in row] for row in made.to_pylist()] == want
