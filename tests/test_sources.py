"""Files, routing and the texts that results are written as."""

import json

import pytest
from pyspark.sql import functions as F

from spanweave.grammar import library
from spanweave.grammar.notation import parse
from spanweave.grammar.program import compiled
from spanweave.operators import spans
from spanweave.operators.parse import parse_by_grammar, parse_documents
from spanweave.sources import files, routing, sinks

LETTERS = "s = (a / b)*^:outer {\n a = @a('x' 'y' 'z')\n b = ' '\n}"


def test_files_are_routed_by_extension_and_language(spark, tmp_path):
    for name, text in {"a.json": "[1]", "b.sql": "SELECT 1", "c.toml": "a = 1", "d.html": "<b>x", "e": "{}", "f.odd": "[2, 3]", "g.SQL": "select 1 +"}.items():
        (tmp_path / name).write_text(text)
    docs = files.read_documents(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    routed = docs.withColumn("grammar", routing.grammar_of(F.col("path")))
    registry = {n: library.program(n) for n in library.NAMES}
    got = {r["name"]: (r.grammar, r.complete) for r in parse_by_grammar(routed, registry, "grammar", "payload", ["name", "grammar"]).collect()}
    assert got == {"a.json": ("json", True), "b.sql": ("sql", True), "c.toml": ("toml", True), "d.html": ("tags", True), "e": ("json", True), "f.odd": ("json", True), "g.SQL": ("sql", False)}
    given = spark.createDataFrame([("x.sql", "toml"), ("x.sql", None), ("x.sql", "cobol"), ("x/y.z/x", None), ("", "SQLite")], "path string, language string")
    assert [r.g for r in given.select(routing.grammar_of(F.col("path"), F.col("language")).alias("g")).collect()] == ["toml", "sql", None, "json", "sql"]
    peg = tmp_path / "g"
    peg.mkdir()
    (peg / "own.peg").write_text(LETTERS)
    assert [(r.grammar, r.source) for r in files.read_grammars(spark, str(peg)).collect()] == [("own", LETTERS)]


def test_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "xyz?? xyz"), (2, "xyz")], "id long, text string")
    parsed = parse_documents(docs, compiled(LETTERS), "text", ["id", "text"], with_tiles=True, with_islands=True)
    got = [json.loads(r.value) for r in sinks.capture_lines(parsed, ["id"], "text").orderBy("id", "capture_idx").collect()]
    assert got[0] == {"start": 0, "end": 3, "kind": "a", "depth": 0, "literal": "xyz"} and len(got) == 5
    lost = [json.loads(r.value) for r in sinks.recovery_lines(parsed, ["id"], "text").orderBy("capture_idx").collect()]
    assert [(x["start"], x["end"], x["literal"], x["label"], x["orphan"]) for x in lost] == [(3, 4, "?", "outer", False), (4, 5, "?", "outer", False)]
    assert [r.value for r in sinks.cluster_lines(spans.clusters(parsed)).collect()] == ["2 recoveries — farthest reach ends at s (label: outer)"]
    assert [r.value for r in sinks.cluster_lines(spans.clusters(parsed.where("id = 2"))).collect()] == [sinks.NO_RECOVERIES]
    sinks.write_lines(sinks.capture_lines(parsed, ["id"], "text"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_colours_and_markers(spark):
    docs = spark.createDataFrame([(1, '["é", 1]'), (2, ""), (3, "[1"), (4, "  ")], "id long, text string")
    parsed = parse_documents(docs, library.program("json"), "text", ["id", "text"], with_tiles=True)
    got = {r.id: (r.shown, r.mark) for r in parsed.select("id", sinks.coloured(parsed, "text").alias("shown"), sinks.partial_marker(parsed).alias("mark")).collect()}
    r, p, s, n = "\x1b[0m", "\x1b[37m", "\x1b[32m", "\x1b[33m"
    assert got[1] == (f'{p}[{r}{s}"é"{r}{p},{r} {n}1{r}{p}]{r}', None)
    assert got[2][0] == "" and got[3][1] == "matched 2 of 2 bytes" and got[4][0] == "  "


def test_grammar_lines(spark):
    g = {"json": parse(library.source("json"))}
    rows = [json.loads(r.value) for r in sinks.stats_lines(spark, g).collect()]
    assert rows[0]["kinds"] and {x["rule"] for x in rows[1:]} == set(g["json"].rules) and len(rows) == 1 + len(g["json"].rules)
    own = parse("s = a 'x' / @k(a [0-9]) { a = 'y' }")
    got = {(r.element, r.text, tuple(map(tuple, r.ranges or ()))) for r in sinks.follow_rows(spark, own, "a").collect()}
    assert got == {("literal", "x", ()), ("chars", None, ((48, 57),))}
    with pytest.raises(KeyError):
        sinks.follow_rows(spark, own, "b")
    assert sinks.follow_lines(spark, own).count() >= 2
