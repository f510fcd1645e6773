"""Edits of documents: (document, seq, start, old_end, replacement) in bytes, applied in the order of ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit(seq, start, old_end, replacement):
    """The struct of one edit: ``start`` to ``old_end`` gives way to ``replacement``."""
    return F.struct(seq.cast("long").alias("seq"), start.cast("long").alias("start"), old_end.cast("long").alias("old_end"), replacement.cast("binary").alias("replacement"))


def insertion(seq, at, text):
    return edit(seq, at, at, text)


def deletion(seq, start, end):
    return edit(seq, start, end, F.lit(b""))


def appended(seq, text):
    """An edit at the end, wherever that is when its turn comes: its range is null."""
    nowhere = F.lit(None).cast("long")
    return edit(seq, nowhere, nowhere, text)


def apply_edits(docs: DataFrame, edits: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``payload`` (binary) and ``error`` of all documents after their edits; those without any stay as they are.

    A null start and end append.  A range that isn't inside the document when its turn comes is refused: the document
    stays as it was before that edit, later ones are not applied, and ``error`` says which (null otherwise).  One
    shuffle by ``key``; an array holds the edits of one document.  Equal ``seq`` are taken by start, then old_end, then
    replacement.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = edits.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(edit(*[F.col(c) for c in ("seq", "start", "old_end", "replacement")]))).alias("_edits"))
    text = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))

    def step(state, e):
        data = state.data
        size = F.octet_length(data)
        begin, end = F.coalesce(e.start, size).cast("int"), F.coalesce(e.old_end, e.start, size).cast("int")
        bad = (begin < 0) | (end < begin) | (end > size)
        made = F.concat(data.substr(F.lit(1), begin), F.coalesce(e.replacement, F.lit(b"")), data.substr(end + 1, size - end))
        error = F.format_string("edit %d: %d..%d in %d bytes", e.seq, begin, end, size)
        return F.when(state.error.isNotNull(), state).otherwise(F.struct(F.when(bad, data).otherwise(made).alias("data"), F.when(bad, error).alias("error")))

    # Dealt by key in as many parts as the join makes anyhow: what is parsed next keeps all cores busy.
    joined = docs.select(key, payload).repartition(parts, key).join(todo, F.col(key).eqNullSafe(F.col("_key")), "left")
    start = F.struct(text.alias("data"), F.lit(None).cast("string").alias("error"))
    after = F.when(F.col("_edits").isNull(), start).otherwise(F.aggregate("_edits", start, step))
    return joined.select(key, after.alias("_after")).select(key, F.col("_after.data").alias(payload), F.col("_after.error").alias("error"))
