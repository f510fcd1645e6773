"""Relational operators over parsed documents.

Each works inside a document's arrays and explodes only what it returns, so that a document is parsed once and nothing
is shuffled but the counts of ``clusters``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def captures(parsed: DataFrame, keep: list[str], kinds: list[str] | None = None, payload: str | None = None) -> DataFrame:
    """One row a capture, parents before children: ``keep``, capture_idx, kind, start, end, depth, parent (-1: none).

    ``kinds``: only captures of these.  ``payload``: also the ``literal`` of each, cut before the rows are made, so
    that no row carries a document.
    """
    fields = ["kind", "start", "end", "depth", "parent"]
    if kinds is None and payload is None:  # arrays need not be made anew
        rows = parsed.select(*keep, F.posexplode("captures").alias("capture_idx", "_c"))
        return rows.select(*keep, "capture_idx", *(f"_c.{f}" for f in fields))
    made = F.transform("captures", lambda c, i: F.struct(i.alias("capture_idx"), *[c[f].alias(f) for f in fields]))
    if kinds is not None:
        made = F.filter(made, lambda c: c.kind.isin(kinds))
    if payload is not None:
        made = F.transform(made, lambda c: F.struct(*[c[f].alias(f) for f in ["capture_idx", *fields]], literal(payload, c.start, c.end).alias("literal")))
    return parsed.select(*keep, F.explode(made).alias("_c")).select(*keep, "_c.*")


def notes(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row a diagnostic."""
    return parsed.select(*keep, F.explode("notes").alias("_n")).select(*keep, "_n.*")


def segments(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Tiles of each document by innermost capture; ``kind`` is null in gaps.  Parse with ``with_tiles``."""
    return parsed.select(*keep, F.explode("tiles").alias("_t")).select(*keep, "_t.start", "_t.end", "_t.kind")


def kind_at(parsed: DataFrame, position: int) -> Column:
    """The kind of the tile over a byte; null in gaps and outside."""
    return F.try_element_at(F.filter("tiles", lambda t: (t.start <= position) & (t.end > position)), F.lit(1)).kind


def literal(payload: str | Column, start: str | Column, end: str | Column) -> Column:
    """The bytes of a span as text; malformed ones are replaced."""
    payload, start, end = (F.col(x) if isinstance(x, str) else x for x in (payload, start, end))
    cut = payload.cast("binary").substr((start + 1).cast("int"), (end - start).cast("int"))
    return F.make_valid_utf8(cut.cast("string"))


def edges(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Each capture's kind with that of its parent (null at the top)."""
    pair = F.transform("captures", lambda c: F.struct(c.kind.alias("kind"), F.get("captures", c.parent).kind.alias("parent_kind")))
    return parsed.select(*keep, F.explode(pair).alias("_e")).select(*keep, "_e.*")


def recovery_spans(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row a span of recoveries: its number in the document, its range and how many captures it has.

    Parse with ``with_islands``, here and below.
    """
    rows = parsed.select(*keep, F.posexplode("islands").alias("span_id", "_i"))
    return rows.select(*keep, "span_id", "_i.start", "_i.end", (F.col("_i.last") - F.col("_i.first") + 1).alias("n_captures"))


def recoveries(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row a recovery capture: its span and the diagnostic that came farthest in it."""
    rows = parsed.select(*keep, "captures", F.posexplode("islands").alias("span_id", "_i"))
    rows = rows.select(*keep, "captures", "span_id", "_i.rule_stack", "_i.label", "_i.told", F.explode(F.sequence("_i.first", "_i.last")).alias("capture_idx"))
    at = F.get("captures", F.col("capture_idx"))
    return rows.select(*keep, "span_id", "capture_idx", at.start.alias("start"), at.end.alias("end"), "rule_stack", "label", "told")


def trimmed(stack: Column, ignored: set[str]) -> Column:
    """A stack of rules without those of ``ignored`` at its end."""
    if not ignored:
        return stack
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.size(stack), F.lit(1))), lambda i: ~F.coalesce(F.try_element_at(stack, i).isin(sorted(ignored)), F.lit(True)))
    return F.slice(stack, F.lit(1), F.coalesce(F.array_max(kept), F.lit(0)))


def clusters(parsed: DataFrame, ignored: set[str] = frozenset()) -> DataFrame:
    """Recovery captures counted by the rules and label of their span's farthest diagnostic (the first of equals).

    Trailing rules of ``ignored`` are cut off the stack.  Columns: leaf, label, rule_stack, n; ``ordered_clusters``
    puts the most frequent first.
    """
    rows = parsed.select(F.explode(F.filter("islands", lambda i: i.told)).alias("_i"))
    rows = rows.select(trimmed(F.col("_i.rule_stack"), ignored).alias("rule_stack"), F.col("_i.label").alias("label"), (F.col("_i.last") - F.col("_i.first") + 1).cast("long").alias("_n"))
    out = rows.groupBy("rule_stack", "label").agg(F.sum("_n").alias("n"))
    return out.select(F.coalesce(F.try_element_at("rule_stack", F.lit(-1)), F.lit("<empty>")).alias("leaf"), "label", "rule_stack", "n")


def ordered_clusters(found: DataFrame) -> DataFrame:
    """Clusters by falling count, then by stack and label."""
    return found.orderBy(F.desc("n"), "rule_stack", F.asc_nulls_first("label"))


def orphan_captures(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Recovery captures whose span has no diagnostic."""
    return recoveries(parsed.withColumn("islands", F.filter("islands", lambda i: ~i.told)), keep).select(*keep, "span_id", "capture_idx", "start", "end")


def orphan_notes(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Diagnostics that belong to no recovery capture."""
    return notes(parsed.withColumn("notes", F.filter("notes", lambda n: ~F.coalesce(F.get("captures", n.capture_index).kind == "recovery", F.lit(False)))), keep)
