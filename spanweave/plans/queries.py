"""Registered queries over the driver's tables and the SQL that they are held against.

Each runs over whole tables.  The SQL says the same by arithmetic or regular expressions, independent of the matcher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals
from ..grammar import library
from ..grammar.notation import parse as read_grammar
from ..operators import edits, grammars, regular, spans
from ..operators.parse import fold_captures, parse_by_grammar, parse_documents, spread
from ..sources import routing, sinks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(spark, sf_dir, table, grammar, payload, keep, with_tiles=False, with_islands=False, only=None) -> DataFrame:
    return parse_documents(_table(spark, sf_dir, table), library.program(grammar), payload, keep, with_tiles, with_islands, only)


def _events(spark, sf_dir, keep, with_tiles=False) -> DataFrame:
    return _parsed(spark, sf_dir, "events", "json", "props", keep, with_tiles)


def captures_json(spark, sf_dir):
    return spans.captures(_events(spark, sf_dir, ["event_id"]), ["event_id"]).select("event_id", "capture_idx", "kind", "start", "end")


def capture_lines(spark, sf_dir):
    """The JSON line of every capture."""
    return sinks.capture_lines(_events(spark, sf_dir, ["event_id", "props"]), ["event_id"], "props").select("event_id", "value")


#: (path, text) of documents in several languages; every other one is broken.
_MIXED = (("q.sql", "SELECT a, b FROM t WHERE k = #"), ("q.sql", "SELECT a, b FROM t WHERE k = "), ("c.toml", "key = #"), ("c.toml", "key = # x"), ("s.css", "a { top: #px }"), ("s.css", "a { top: #px"), ("d.json", '{"k": #}'), ("d", '{"k": #'))


#: Likewise for programming languages and YAML.
_CODE = (
    ("f.c", "int f(int k) { return k + #; }"), ("f.c", "int f(int k) { return k + # }"),
    ("f.go", "package p\nfunc f(k int) int {\n\treturn k + #\n}\n"), ("f.go", "package p\nfunc f(k int) int {\n\treturn k + # k\n}\n"),
    ("f.mjs", "const f = (k) => k + #\nf(k)"), ("f.mjs", "const f = (k) => k + # f(k)"),
    ("f.rs", "fn f(k: u32) -> u32 { k + # }"), ("f.rs", "fn f(k: u32) -> u32 { k + # k }"),
    ("f.bzl", "def f(k):\n    return k + #\n"), ("f.bzl", "def f(k):\n    return k + #\n  pass\n"),
    ("f.yml", "f:\n  k: #\n"), ("f.yml", "f:\n  k: #\n g: k\n"),
)


def routed_documents(spark, sf_dir):
    """A document an order, in a language by its path: how many are matched as a whole, and their numbers."""
    return _routed(spark, sf_dir, _MIXED, ("css", "json", "sql", "toml"))


def routed_code(spark, sf_dir):
    """The same for programming languages and YAML."""
    return _routed(spark, sf_dir, _CODE, ("c", "go", "javascript", "rust", "starlark", "yaml"))


def _routed(spark, sf_dir, texts, names):
    which = (F.col("o_orderkey") % len(texts)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in texts]), which)
    docs = _table(spark, sf_dir, "orders").select(pick(0).alias("path"), F.replace(pick(1), F.lit("#"), F.col("o_orderkey").cast("string")).alias("text"))
    routed = docs.withColumn("grammar", routing.grammar_of(F.col("path")))
    parsed = parse_by_grammar(routed, {n: library.program(n) for n in names}, "grammar", "text", ["grammar"])
    numbers = F.size(F.filter("captures", lambda c: c.kind == "number")).cast("long")
    return parsed.groupBy("grammar", "complete").agg(F.count("*").alias("n"), F.sum(numbers).alias("n_numbers"))


def captures_by_kind(spark, sf_dir):
    return spans.captures(_events(spark, sf_dir, []), []).groupBy("kind").agg(F.count("*").alias("n"))


def capture_number_sum(spark, sf_dir):
    found = spans.captures(_events(spark, sf_dir, ["event_type", "props"]), ["event_type"], ["number"], "props")
    return found.groupBy("event_type").agg(F.sum(F.col("literal").cast("long")).alias("total"))


def segments_json(spark, sf_dir):
    return spans.segments(_events(spark, sf_dir, ["event_id"], True), ["event_id"])


def gap_bytes(spark, sf_dir):
    rows = spans.segments(_events(spark, sf_dir, ["event_type"], True), ["event_type"])
    return rows.groupBy("event_type").agg(F.sum(F.when(F.col("kind").isNull(), F.col("end") - F.col("start")).otherwise(0)).alias("gap_bytes"))


def tiling_check(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "documents", "lines", "text", ["doc_id"], True, only=["n_bytes", "tiles"])
    covered = F.aggregate("tiles", F.lit(0).cast("long"), lambda acc, t: acc + t.end - t.start)
    return parsed.select("doc_id", "n_bytes", covered.alias("covered"))


def literal_slice(spark, sf_dir):
    return spans.captures(_events(spark, sf_dir, ["event_id", "props"]), ["event_id"], ["property", "number"], "props").select("event_id", "kind", "literal")


def truncate_literal(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", literals.truncated(F.col("props"), 5).alias("shown"))


def quote_literal(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", literals.quoted(F.col("props")).alias("quoted"))


def kind_colours(spark, sf_dir):
    return captures_by_kind(spark, sf_dir).select("kind", literals.colour(F.col("kind")).alias("colour"))


def kind_covering_byte(spark, sf_dir):
    parsed = _events(spark, sf_dir, ["event_id"], True)
    return parsed.select("event_id", *(spans.kind_at(parsed, i).alias(f"at_{i}") for i in (0, 1, 4, 5, 6)))


def _found(spark, sf_dir, table, grammar, payload, kind, keep) -> DataFrame:
    return regular.found(_table(spark, sf_dir, table), library.program(grammar), payload, kind, keep)


def _n_found():
    return F.size("literals").cast("long")


def word_tokens(spark, sf_dir):
    return _found(spark, sf_dir, "documents", "lines", "text", "word", ["doc_id"]).select("doc_id", _n_found().alias("n_words"))


def line_tokens(spark, sf_dir):
    return _found(spark, sf_dir, "documents", "lines", "text", "line", ["doc_id"]).select("doc_id", _n_found().alias("n_lines"))


def turn_tokens(spark, sf_dir):
    counted = _found(spark, sf_dir, "conversations", "lines", "text", "word", ["role"]).select("role", _n_found().alias("_n"))
    return counted.groupBy("role").agg(F.sum("_n").alias("n_words"), F.count("*").alias("n_turns"))


def tag_tokens(spark, sf_dir):
    names = _found(spark, sf_dir, "pages", "tags", "html", "name", []).select(F.explode("literals").alias("_name"))
    return names.groupBy(F.lower("_name").alias("tag")).agg(F.count("*").alias("n"))


def comment_spans(spark, sf_dir):
    return _found(spark, sf_dir, "pages", "tags", "html", "comment", ["page_id"]).select("page_id", _n_found().alias("n_comments"))


def partial_matches(spark, sf_dir):
    return _parsed(spark, sf_dir, "documents", "json", "text", ["doc_id"], only=["n_bytes", "complete"]).where("not complete").select("doc_id", "n_bytes")


def depth_hist(spark, sf_dir):
    rows = spans.captures(_parsed(spark, sf_dir, "documents", "lines", "text", [], only=["captures"]), [])
    return rows.groupBy("depth", "kind").agg(F.count("*").alias("n"))


def parent_edges(spark, sf_dir):
    return spans.edges(_parsed(spark, sf_dir, "documents", "lines", "text", [], only=["captures"]), []).groupBy("parent_kind", "kind").agg(F.count("*").alias("n"))


def fold_count(spark, sf_dir):
    words = regular.nested(library.program("lines"), "text", "line", "word")
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = docs.select("doc_id", F.transform(words, lambda line: F.size(line).cast("long")).alias("_sizes"))
    found = sizes.select("doc_id", F.array_max("_sizes").alias("most_words"), F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"))
    return found.where("n_words > 0")


def recovery_spans(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "documents", "words", "text", ["doc_id"], with_islands=True, only=["islands"])
    total = lambda f: F.aggregate("islands", F.lit(0).cast("long"), lambda a, i: a + f(i))
    found = parsed.where(F.size("islands") > 0)
    return found.select("doc_id", F.size("islands").cast("long").alias("n_spans"), total(lambda i: i.end - i.start).alias("n_bytes"), total(lambda i: i["last"] - i["first"] + 1).alias("n_captures"))


def recovery_rows(spark, sf_dir):
    """Every recovery with its span and the diagnostic of that."""
    parsed = _parsed(spark, sf_dir, "documents", "words", "text", ["doc_id"], with_islands=True, only=["captures", "islands"])
    return spans.recoveries(parsed, ["doc_id"]).select("doc_id", "start", "end", F.element_at("rule_stack", -1).alias("leaf"), "label")


def recovery_clusters(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "documents", "words", "text", [], with_islands=True, only=["islands"])
    return spans.ordered_clusters(spans.clusters(parsed)).select("leaf", "label", "n")


def orphan_checks(spark, sf_dir):
    """Orphans by kind: there are none, unless rows are made to have some, as here every document with an odd id."""
    parsed = _parsed(spark, sf_dir, "documents", "words", "text", ["doc_id"], with_islands=True, only=["captures", "notes", "islands"])
    odd = F.col("doc_id") % 2 == 1
    parsed = parsed.withColumn("islands", F.when(odd, F.transform("islands", lambda i: i.withField("told", F.lit(False)))).otherwise(F.col("islands")))
    captures_ = F.aggregate(F.filter("islands", lambda i: ~i.told), F.lit(0).cast("long"), lambda a, i: a + i["last"] - i["first"] + 1)
    orphans = F.filter("notes", lambda n: ~F.coalesce(F.get("captures", n.capture_index).kind == "recovery", F.lit(False)))
    counted = parsed.select((F.col("doc_id") % 2).alias("odd"), captures_.alias("_c"), F.size(orphans).cast("long").alias("_n"))
    return counted.groupBy("odd").agg(F.sum("_c").alias("captures"), F.sum("_n").alias("notes"))


def capture_heights(spark, sf_dir):
    """The fold that gives each outermost capture the height of its tree."""
    parsed = _events(spark, sf_dir, ["event_id"])
    return fold_captures(parsed, ["event_id"], lambda kind, start, end, below: 1 + max(below, default=0), "long").select("event_id", F.col("roots").alias("heights"))


def captures_by_lang(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = _table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")  # others needn't be read closely
    counted = regular.found(docs, library.program("lines"), "text", "word", ["doc_id", "lang"]).select("doc_id", "lang", _n_found().alias("_n"))
    return counted.join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n_docs"), F.sum("_n").alias("n_words"))


def edit_replay(spark, sf_dir):
    """Two edits an event: the number gives way to a list of itself and 7, then a blank is put in front."""
    events = _table(spark, sf_dir, "events")
    size = F.octet_length("props").cast("long")
    first = events.select("event_id", F.lit(1).alias("seq"), F.lit(6).cast("long").alias("start"), (size - 1).alias("old_end"), F.concat(F.lit("["), F.expr("substring(props, 7, length(props) - 7)"), F.lit(", 7]")).alias("replacement"))
    second = events.select("event_id", F.lit(2).alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("old_end"), F.lit(" ").alias("replacement"))
    after = edits.apply_edits(events.select("event_id", "props"), first.unionAll(second), "event_id", "props")
    parsed = parse_documents(after.where("error is null"), library.program("json"), "props", ["event_id"])
    return parsed.select("event_id", "n_bytes", "complete", F.size("captures").cast("long").alias("n_captures"))


def _sources():
    return {name: read_grammar(library.source(name)) for name in library.NAMES}


def rule_reference_counts(spark, sf_dir):
    return grammars.rule_table(spark, _sources())


def grammar_stats(spark, sf_dir):
    return grammars.stats_table(spark, _sources())


def follow_sets(spark, sf_dir):
    return grammars.follow_table(spark, _sources())


def lint_findings(spark, sf_dir):
    return grammars.lint_table(spark, _sources())


QUERIES = {
    f.__name__: f
    for f in (
        captures_json, capture_lines, routed_documents, routed_code, captures_by_kind, capture_number_sum, segments_json, gap_bytes, tiling_check, literal_slice,
        truncate_literal, quote_literal, kind_colours, kind_covering_byte, word_tokens, line_tokens, turn_tokens, tag_tokens, comment_spans, partial_matches,
        depth_hist, parent_edges, fold_count, recovery_spans, recovery_rows, recovery_clusters, orphan_checks, capture_heights, captures_by_lang,
        edit_replay, rule_reference_counts, grammar_stats, follow_sets, lint_findings,
    )
}

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))"
_LINES = "len(regexp_extract_all(coalesce(text, ''), '[^\\n]+'))"
_BYTES = "strlen(coalesce(text, ''))"
_ODD = "regexp_replace(coalesce(text, ''), '[A-Za-z \\t\\n\\r]', '', 'g')"
_NO_COMMENTS = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
_NUMBER = "CAST(json_extract(props, '$.k') AS BIGINT)"

ORACLE_SQL: dict[str, str] = {
    "captures_json": """
        SELECT event_id, CAST(c.i AS INTEGER) AS capture_idx, c.k AS kind, CAST(c.s AS BIGINT) AS "start", CAST(c.e AS BIGINT) AS "end"
        FROM (SELECT event_id, unnest([
            {'i': 0, 'k': 'punctuation', 's': 0, 'e': 1}, {'i': 1, 'k': 'property', 's': 1, 'e': 4},
            {'i': 2, 'k': 'punctuation', 's': 4, 'e': 5}, {'i': 3, 'k': 'number', 's': 6, 'e': strlen(props) - 1},
            {'i': 4, 'k': 'punctuation', 's': strlen(props) - 1, 'e': strlen(props)}]) AS c FROM events)""",
    "capture_lines": """
        SELECT event_id, '{"start":' || s || ',"end":' || e || ',"kind":"' || k || '","depth":0,"literal":' || CAST(to_json(substr(props, s + 1, e - s)) AS VARCHAR) || '}' AS value
        FROM (SELECT event_id, props, c.k AS k, c.s AS s, c.e AS e FROM (SELECT event_id, props, unnest([
            {'k': 'punctuation', 's': 0, 'e': 1}, {'k': 'property', 's': 1, 'e': 4}, {'k': 'punctuation', 's': 4, 'e': 5},
            {'k': 'number', 's': 6, 'e': strlen(props) - 1}, {'k': 'punctuation', 's': strlen(props) - 1, 'e': strlen(props)}]) AS c FROM events))""",
    "routed_documents": """
        SELECT ['sql', 'toml', 'css', 'json'][(o_orderkey % 8) // 2 + 1] AS grammar, o_orderkey % 2 = 0 AS complete, count(*) AS n,
            CAST(sum(CASE WHEN o_orderkey % 8 = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_numbers FROM orders GROUP BY ALL""",
    "routed_code": """
        SELECT ['c', 'go', 'javascript', 'rust', 'starlark', 'yaml'][(o_orderkey % 12) // 2 + 1] AS grammar, o_orderkey % 2 = 0 AS complete,
            count(*) AS n, count(*) AS n_numbers FROM orders GROUP BY ALL""",
    "captures_by_kind": """
        SELECT kind, CAST(n AS BIGINT) AS n FROM (
            SELECT 'punctuation' AS kind, 3 * count(*) AS n FROM events UNION ALL SELECT 'property', count(*) FROM events
            UNION ALL SELECT 'number', count(*) FROM events)""",
    "capture_number_sum": f"SELECT event_type, CAST(sum({_NUMBER}) AS BIGINT) AS total FROM events GROUP BY event_type",
    "segments_json": """
        SELECT event_id, CAST(c.s AS BIGINT) AS "start", CAST(c.e AS BIGINT) AS "end", c.k AS kind
        FROM (SELECT event_id, unnest([
            {'k': 'punctuation', 's': 0, 'e': 1}, {'k': 'property', 's': 1, 'e': 4}, {'k': 'punctuation', 's': 4, 'e': 5},
            {'k': NULL, 's': 5, 'e': 6}, {'k': 'number', 's': 6, 'e': strlen(props) - 1},
            {'k': 'punctuation', 's': strlen(props) - 1, 'e': strlen(props)}]) AS c FROM events)""",
    "gap_bytes": "SELECT event_type, CAST(count(*) AS BIGINT) AS gap_bytes FROM events GROUP BY event_type",
    "tiling_check": f"SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n_bytes, CAST({_BYTES} AS BIGINT) AS covered FROM documents",
    "literal_slice": f"""
        SELECT event_id, 'property' AS kind, '"k"' AS literal FROM events
        UNION ALL SELECT event_id, 'number', CAST({_NUMBER} AS VARCHAR) FROM events""",
    "truncate_literal": "SELECT event_id, CASE WHEN strlen(props) <= 5 THEN props ELSE left(props, 5) || '…' END AS shown FROM events",
    "quote_literal": "SELECT event_id, CAST(to_json(props) AS VARCHAR) AS quoted FROM events",
    "kind_colours": """
        SELECT 'punctuation' AS kind, chr(27) || '[37m' AS colour UNION ALL SELECT 'property', chr(27) || '[36m'
        UNION ALL SELECT 'number', chr(27) || '[33m'""",
    "kind_covering_byte": """
        SELECT event_id, 'punctuation' AS at_0, 'property' AS at_1, 'punctuation' AS at_4, CAST(NULL AS VARCHAR) AS at_5,
            'number' AS at_6 FROM events""",
    "word_tokens": f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_words FROM documents",
    "line_tokens": f"SELECT doc_id, CAST({_LINES} AS BIGINT) AS n_lines FROM documents",
    "turn_tokens": f"SELECT role, CAST(sum({_WORDS}) AS BIGINT) AS n_words, count(*) AS n_turns FROM conversations GROUP BY role",
    "tag_tokens": f"""
        SELECT lower(t) AS tag, count(*) AS n FROM (
            SELECT unnest(regexp_extract_all({_NO_COMMENTS}, '</?([A-Za-z][A-Za-z0-9]*)[^>]*>', 1)) AS t FROM pages) GROUP BY lower(t)""",
    "comment_spans": "SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->')) AS BIGINT) AS n_comments FROM pages",
    "partial_matches": f"SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n_bytes FROM documents WHERE text IS NULL OR NOT json_valid(text)",
    "depth_hist": f"""
        SELECT 0::INTEGER AS depth, 'line' AS kind, CAST(sum({_LINES}) AS BIGINT) AS n FROM documents
        UNION ALL SELECT 1::INTEGER, 'word', CAST(sum({_WORDS}) AS BIGINT) FROM documents""",
    "parent_edges": f"""
        SELECT CAST(NULL AS VARCHAR) AS parent_kind, 'line' AS kind, CAST(sum({_LINES}) AS BIGINT) AS n FROM documents
        UNION ALL SELECT 'line', 'word', CAST(sum({_WORDS}) AS BIGINT) FROM documents""",
    "fold_count": f"""
        SELECT doc_id, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[A-Za-z]+')))) AS BIGINT) AS most_words,
            CAST({_WORDS} AS BIGINT) AS n_words FROM documents WHERE {_WORDS} > 0""",
    "recovery_spans": f"""
        SELECT doc_id, CAST(len(regexp_extract_all(text, '[^A-Za-z \\t\\n\\r]+')) AS BIGINT) AS n_spans,
            CAST(strlen({_ODD}) AS BIGINT) AS n_bytes, CAST(length({_ODD}) AS BIGINT) AS n_captures
        FROM documents WHERE {_ODD} <> ''""",
    "recovery_clusters": f"""
        SELECT 'text' AS leaf, 'recovery' AS label, CAST(sum(length({_ODD})) AS BIGINT) AS n FROM documents HAVING sum(length({_ODD})) > 0""",
    "orphan_checks": f"""
        SELECT doc_id % 2 AS odd, CAST(sum(CASE WHEN doc_id % 2 = 1 THEN length({_ODD}) ELSE 0 END) AS BIGINT) AS captures, CAST(0 AS BIGINT) AS notes FROM documents GROUP BY doc_id % 2""",
    "recovery_rows": f"""
        WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents),
        b AS (SELECT doc_id, substr(text, i, 1) AS c, sum(strlen(substr(text, i, 1))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM c)
        SELECT doc_id, CAST(e - strlen(c) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", 'text' AS leaf, 'recovery' AS label
        FROM b WHERE NOT regexp_matches(c, '[A-Za-z \\t\\n\\r]')""",
    "capture_heights": "SELECT event_id, [1, 1, 1, 1, 1]::BIGINT[] AS heights FROM events",
    "captures_by_lang": f"""
        SELECT lang, quality, count(*) AS n_docs, CAST(sum({_WORDS}) AS BIGINT) AS n_words
        FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality""",
    "edit_replay": "SELECT event_id, CAST(strlen(props) + 6 AS BIGINT) AS n_bytes, true AS complete, CAST(9 AS BIGINT) AS n_captures FROM events",
}
