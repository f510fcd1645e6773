"""Benchmark decontamination: pigeonhole edit matching of test items inside whole documents.

Texts and items are lower-cased and white-space runs become one space.  An item of m characters may differ by
k = m // PIECE - 1 edits (at least 0); cut into k + 1 pieces, at least one piece occurs unchanged in any such match.
One automaton finds all pieces; around each hit, Myers' bit-parallel algorithm finds the least edit distance of the
whole item to a part of the text.

Items go to the workers in blocks of bounded size, one pass over the documents a block, so that the benchmark may
have any size; with a block's worth of items or less, there is one pass.

Edge cases.  Null or blank texts match nothing; null or blank items are ignored.  Items with equal texts all match.
An item matches a document once: least distance, then the first place.  start and end are character offsets into
the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

PIECE = 20
#: Characters of items that a worker holds at once.
BLOCK_CHARS = 2 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, piece: int = PIECE) -> int:
    return max(0, length // piece - 1)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of nearly equal length and where they begin."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of text, first end of such a part)."""
    m = len(pattern)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(zero | up) & full, up & zero
        if score < best[0]:
            best = (score, j)
    return best


def place(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the best part of text."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    distance, end = myers(pattern, text)
    back, length = myers(pattern[::-1], text[:end][::-1])
    return distance, end - (length if back == distance else min(end, len(pattern))), end


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        import ahocorasick

        self.items = [(key, text, budget(len(text), piece)) for key, text in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            for begin, part in pieces(text, k):
                by_piece.setdefault(part, []).append((i, begin))
        self.automaton = ahocorasick.Automaton()
        for part, owners in by_piece.items():
            self.automaton.add_word(part, (len(part), owners))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item key, distance, start, end) of every item that matches; offsets in the normal text."""
        if self.empty:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, owners) in self.automaton.iter(text):
            for i, begin in owners:
                _, item, k = self.items[i]
                start = last + 1 - length - begin
                a, b = max(0, start - k), min(len(text), start + len(item) + k)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                    own[-1][0] = min(own[-1][0], a)
                else:
                    own.append([a, b])
        out = []
        for i, spans in windows.items():
            key, item, k = self.items[i]
            found = min((d, a + s, a + e) for a, b in spans for d, s, e in [place(item, text[a:b])])
            if found[0] <= k:
                out.append((key, *found))
        return sorted(out)


def origins(text: str) -> list[int]:
    """For each character of ``normal(text)``, its place in ``text``; at the end, the end of the last word."""
    out: list[int] = []
    end = 0
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(end)
        for at in range(m.start(), m.end()):
            out.extend([at] * len(text[at].lower()))
        end = m.end()
    return [*out, end]


def _matcher(held) -> Matcher:
    """One matcher a worker and block."""
    return store.held_once(("matcher", held.id), lambda: Matcher(held.value))


class _Held:
    """A broadcast block of items with a name that is the same in every worker."""

    def __init__(self, broadcast, name):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", block_chars: int = BLOCK_CHARS) -> list[_Held]:
    """The items in blocks of about ``block_chars`` characters, each broadcast."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null and item_id is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = sorted({(r.item_id, normal(r.text)) for r in part.toLocalIterator() if r.text.strip()})
        sent = spark.sparkContext.broadcast(items)
        out.append(_Held(sent, (spark.sparkContext.applicationId, sent._jbroadcast.id())))
    return out


MATCH = "item_id long, distance int, start int, end int"


def _matches(held: _Held, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    matcher, out = _matcher(held), []
    for text in texts.to_pylist():
        found = matcher.find(normal(text))
        if found:
            at = origins(text)
            found = [(key, d, at[s], at[e - 1] + 1 if e > s else at[s]) for key, d, s, e in found]
        out.append(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, start, end): one row for each item that a document contains."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for held in item_blocks(benchmark):

        def work(batch, texts, held=held):
            found = _matches(held, texts)
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64)
            flat = [x for own in found for x in own]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner))] + [pa.array([x[i] for x in flat], kinds[i]) for i in range(4)], ["doc_id", "item_id", "distance", "start", "end"])

        part = store.map_slices(docs, "text", work, f"doc_id long, {MATCH}")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that contain no item."""
    mark = store.free_name("_leaks", docs)
    for held in item_blocks(benchmark):
        counted = store.with_columns(docs, text, lambda texts, held=held: [pa.array([len(x) for x in _matches(held, texts)], pa.int32())], f"`{mark}` int")
        docs = counted.where(F.col(mark) == 0).drop(mark)
    return docs
