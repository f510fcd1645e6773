"""A stream of edits: each document is kept as state, and what it matches is told after each micro-batch.

The state of a document is its bytes and the last ``seq`` that was applied.  Edits of a micro-batch are applied in the
order of ``seq``; one that was seen before (``seq`` not above the last) is passed over, so that a batch that is
replayed after a failure changes nothing.  After its edits a document is matched anew as a whole: what is told is by
construction what a fresh match of the text gives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar import program as programs
from ..grammar.program import Program
from ..operators.parse import _matcher

OUTPUT = "key string, seq long, text binary, matched long, complete boolean, n_captures long, error string"
STATE = "text binary, seq long"


def edited(text: bytes, start, old_end, replacement) -> bytes:
    """``text`` after one edit; a null range appends.  ValueError for a range that isn't inside."""
    begin = len(text) if pd.isna(start) else int(start)
    end = begin if pd.isna(old_end) else int(old_end)
    if not 0 <= begin <= end <= len(text):
        raise ValueError(f"{begin}..{end} in {len(text)} bytes")
    return text[:begin] + (replacement or b"") + text[end:]


def matched_edits(edits: DataFrame, program: Program, key: str) -> DataFrame:
    """For each document that a micro-batch edits, its text and match afterwards.

    ``edits``: ``key``, seq, start, old_end, replacement, with or without a stream behind it.  A refused edit stops
    those after it in the same micro-batch and is named in ``error``; its ``seq`` counts as applied.
    """
    data = programs.encode(program)

    def step(keys, frames, state):
        text, last = state.get if state.exists else (b"", -1)
        text = bytes(text)
        rows = pd.concat(list(frames)).sort_values(["seq", "start", "old_end"], kind="stable")
        error, told = None, last
        for r in rows.itertuples(index=False):
            if r.seq <= last:
                continue
            told = max(told, int(r.seq))
            if error is None:
                try:
                    text = edited(text, r.start, r.old_end, r.replacement)
                except ValueError as e:
                    error = f"edit {r.seq}: {e}"
        state.update((text, told))
        found = _matcher(data).match(text)
        yield pd.DataFrame({"key": [keys[0]], "seq": [told], "text": [text], "matched": [found.matched], "complete": [found.complete], "n_captures": [len(found.captures)], "error": [error]})

    rows = edits.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("double").alias("start"), F.col("old_end").cast("double").alias("old_end"), F.col("replacement").cast("binary").alias("replacement"))
    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "update", "NoTimeout")
