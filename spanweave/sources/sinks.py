"""Results as lines of text: columns ``value`` that ``write_lines`` writes, one JSON object or sentence a row.

All but the two for grammars are built-in functions over parsed documents; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals
from ..grammar import analysis
from ..grammar.notation import Grammar
from ..grammar.program import compile_grammar
from ..operators import spans

NO_RECOVERIES = "no recoveries"


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def capture_lines(parsed: DataFrame, keep: list[str], payload: str) -> DataFrame:
    """A JSON object a capture: start, end, kind, depth, literal."""
    rows = spans.captures(parsed, keep, None, payload)
    return rows.select(*keep, "capture_idx", _json(**{c: F.col(c) for c in ("start", "end", "kind", "depth", "literal")}).alias("value"))


def recovery_lines(parsed: DataFrame, keep: list[str], payload: str) -> DataFrame:
    """A JSON object a recovery: its span, literal, and the diagnostic of its span; and one a diagnostic that belongs
    to no recovery.  ``orphan`` is true for these and for recoveries whose span has no diagnostic."""
    whole = list(dict.fromkeys([*keep, payload]))
    rows = spans.recoveries(parsed, whole)
    cut = spans.literal(F.col(payload), F.col("start"), F.col("end"))
    made = rows.select(*keep, "capture_idx", _json(start=F.col("start"), end=F.col("end"), literal=cut, rule_stack=F.col("rule_stack"), label=F.col("label"), orphan=~F.col("told")).alias("value"))
    lost = spans.orphan_notes(parsed, keep)
    told = _json(capture_index=F.col("capture_index"), pos=F.col("pos"), rule_stack=F.col("rule_stack"), label=F.col("label"), orphan=F.lit(True))
    return made.unionAll(lost.select(*keep, F.col("capture_index").alias("capture_idx"), told.alias("value")))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """A sentence a cluster, the most frequent first; one that says so where there are none."""
    count = F.format_string("%d %s", F.col("n"), F.when(F.col("n") == 1, "recovery").otherwise("recoveries"))
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit(" (label: "), F.col("label"), F.lit(")"))).otherwise(F.lit(""))
    said = clusters.select("n", "rule_stack", "label", F.concat(count, F.lit(" — farthest reach ends at "), F.col("leaf"), label).alias("value"))
    nothing = clusters.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("rule_stack"), F.lit(None).cast("string").alias("label"), F.lit(NO_RECOVERIES).alias("value"))
    return said.unionAll(nothing).orderBy(F.desc("n"), "rule_stack", F.asc_nulls_first("label")).select("value")


def coloured(parsed: DataFrame, payload: str) -> Column:
    """The whole document with ANSI escapes where the colour changes.  Parse with ``with_tiles``; ``payload`` is kept."""
    reset = "\x1b[0m"
    colour = F.transform("tiles", lambda t: F.coalesce(literals.colour(t.kind), F.lit("")))
    piece = lambda t, i: F.concat(
        F.when(F.get(colour, i) == F.coalesce(F.get(colour, i - 1), F.lit("")), F.lit("")).when(F.get(colour, i) == "", F.lit(reset)).otherwise(F.concat(F.when(F.coalesce(F.get(colour, i - 1), F.lit("")) != "", F.lit(reset)).otherwise(F.lit("")), F.get(colour, i))),
        spans.literal(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), t.start, t.end),
    )
    end = F.when(F.coalesce(F.get(colour, F.size(colour) - 1), F.lit("")) != "", F.lit(reset)).otherwise(F.lit(""))
    return F.concat(F.array_join(F.transform("tiles", piece), ""), end)


def partial_marker(parsed: DataFrame) -> Column:
    """A sentence for a document that isn't matched as a whole, null for others."""
    return F.when(~F.col("complete"), F.format_string("matched %d of %d bytes", F.col("matched"), F.col("n_bytes")))


def stats_lines(spark: SparkSession, grammars: dict[str, Grammar]) -> DataFrame:
    """For each grammar a header object and one a rule, as a grammar's size bounds them."""
    import json

    rows = []
    for name, g in sorted(grammars.items()):
        p, counts = compile_grammar(g), analysis.reference_counts(g)
        rows.append((json.dumps({"grammar": name, "n_nodes": p.size, "n_rules": len(g.rules), "kinds": p.kinds, "n_sets": len(p.sets)}),))
        for rule in sorted(g.rules, key=lambda r: (-counts.get(r, 0), r)):
            a, b = g.rules[rule].body_span
            rows.append((json.dumps({"grammar": name, "rule": rule, "refs": counts.get(rule, 0), "body_chars": len(g.source[a:b].strip())}),))
    return spark.createDataFrame(rows, "value string")


def follow_rows(spark: SparkSession, grammar: Grammar, rule: str | None = None) -> DataFrame:
    """(rule, element, text, ranges, capture): what may come after each rule, or after one; typed.

    ``element`` is literal, chars, rule, any or eof; ``text`` is a literal or a rule's name, ``ranges`` are those of a
    set, ``capture`` the kinds of the captures around it, outermost first.
    """
    after = analysis.follow(grammar)
    if rule is not None and rule not in after:
        raise KeyError(f"no rule is named {rule}")
    rows = []
    for name in sorted(after) if rule is None else [rule]:
        for x in after[name]:
            kinds = []
            while x[0] == "capture":
                kinds.append(x[1])
                x = x[2]
            text = x[1] if x[0] in ("literal", "rule") else None
            rows.append((name, x[0], text, [tuple(r) for r in x[1]] if x[0] == "chars" else None, kinds))
    return spark.createDataFrame(sorted(rows, key=repr), "rule string, element string, text string, ranges array<struct<lo:int,hi:int>>, capture array<string>")


def follow_lines(spark: SparkSession, grammar: Grammar, rule: str | None = None) -> DataFrame:
    return follow_rows(spark, grammar, rule).select(F.to_json(F.struct("rule", "element", "text", "ranges", "capture")).alias("value"))
