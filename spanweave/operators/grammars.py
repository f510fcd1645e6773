"""Grammars as tables: rules with reference counts, FOLLOW sets and lint findings.

A grammar is a driver-side value of kilobytes, so these tables are made from local rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..grammar import analysis
from ..grammar.notation import Grammar
from ..grammar.program import compile_grammar


def rule_table(spark: SparkSession, grammars: dict[str, Grammar]) -> DataFrame:
    """grammar, rule, refs, body_chars, by grammar and rule."""
    rows = []
    for name, g in sorted(grammars.items()):
        counts = analysis.reference_counts(g)
        for rule in sorted(g.rules):
            a, b = g.rules[rule].body_span
            rows.append((name, rule, counts.get(rule, 0), len(g.source[a:b].strip())))
    return spark.createDataFrame(rows, "grammar string, rule string, refs long, body_chars long")


def stats_table(spark: SparkSession, grammars: dict[str, Grammar]) -> DataFrame:
    """grammar, n_nodes, n_rules, kinds, n_sets of each compiled grammar."""
    rows = []
    for name, g in sorted(grammars.items()):
        p = compile_grammar(g)
        rows.append((name, p.size, len(g.rules), p.kinds, len(p.sets)))
    return spark.createDataFrame(rows, "grammar string, n_nodes long, n_rules long, kinds array<string>, n_sets long")


def follow_table(spark: SparkSession, grammars: dict[str, Grammar]) -> DataFrame:
    """grammar, rule, element: what may come after each rule, as text."""
    rows = [(name, rule, str(x)) for name, g in sorted(grammars.items()) for rule, found in sorted(analysis.follow(g).items()) for x in sorted(map(str, found))]
    return spark.createDataFrame(rows, "grammar string, rule string, element string")


def lint_table(spark: SparkSession, grammars: dict[str, Grammar]) -> DataFrame:
    """grammar, finding: distinct findings as text."""
    rows = sorted({(name, str(x)) for name, g in grammars.items() for x in analysis.lint(g)})
    return spark.createDataFrame(rows, "grammar string, finding string")
