"""Documents under grammars of runs, many at once and without a step for each character.

In a grammar of runs the next character alone tells what is matched: the root is a loop whose alternatives are single
characters or runs of them, of sets that have nothing in common, and a captured run may be such a loop again.  Words,
lines of words and their recoveries are of this kind.  Where a character lies is then a matter of its class, and a
capture begins where the class of the character before is outside of it: both are found in whole arrays of bytes.

``plan`` says None where a grammar is of another kind.  It tells all bytes from 0x80 on from ASCII, but not from each
other.  Documents must be valid UTF-8 (``valid``); others are for the matcher, which gives the same captures and notes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..grammar.patterns import EOF, Any, Capture, Catch, Chars, Choice, Literal, Pattern, Plus, Ref, Seq, Star
from ..grammar.program import Program


class _Other(Exception):
    """Not a grammar of runs."""


@dataclass
class Node:
    """A capture: which bytes lie in it, whether neighbours share one, how many captures are around it."""

    kind: str
    inside: np.ndarray
    run: bool
    depth: int
    told: bool = False


@dataclass
class Plan:
    nodes: list[Node] = field(default_factory=list)
    #: Label and rules of the diagnostic of every rescue.
    label: str | None = None
    rule_stack: list[str] | None = None


@dataclass
class Found:
    """Captures of all documents in order, each with its node, range and parent within its document (-1: none);
    ``bounds[i]:bounds[i + 1]`` are those of document i."""

    node: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    bounds: np.ndarray


def _bytes_of(ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    high = 0
    for lo, hi in ranges:
        out[lo : min(hi, 127) + 1] = True
        lo = max(lo, 128)
        if hi >= lo:
            high += hi - lo + 1 - max(0, min(hi, 0xDFFF) - max(lo, 0xD800) + 1)
    if high not in (0, 0x110000 - 0x80 - 0x800):
        raise _Other
    out[128:] = high > 0
    return out


class _Reader:
    def __init__(self, program: Program):
        self.program, self.plan = program, Plan()

    def open(self, p: Pattern, names: tuple[str, ...]) -> tuple[Pattern, tuple[str, ...]]:
        while isinstance(p, Ref):
            if p.name in names or p.name in self.program.left_recursive:
                raise _Other
            p, names = self.program.rules[p.name], (*names, p.name)
        return p, names

    def ways(self, p: Pattern, names: tuple[str, ...], depth: int) -> np.ndarray:
        """The bytes that the alternatives of ``p`` take, each of which is added to the plan."""
        p, names = self.open(p, names)
        if not isinstance(p, Choice):
            return self.way(p, names, depth)
        out = np.zeros(256, bool)
        for x in p.items:
            own = self.ways(x, names, depth)
            if (own & out).any():
                raise _Other
            out |= own
        return out

    def way(self, p: Pattern, names: tuple[str, ...], depth: int) -> np.ndarray:
        if not isinstance(p, Capture):
            return self.plain(p, names)[0]
        at = len(self.plan.nodes)
        self.plan.nodes.append(None)
        body, names = self.open(p.body, names)
        try:
            inside, run = self.plain(body, names)
        except _Other:
            if not isinstance(body, Plus):
                raise
            inside, run = self.ways(body.body, names, depth + 1), True
        self.plan.nodes[at] = Node(p.kind, inside, run, depth)
        return inside

    def plain(self, p: Pattern, names: tuple[str, ...]) -> tuple[np.ndarray, bool]:
        """The bytes of a character or run without captures."""
        p, names = self.open(p, names)
        match p:
            case Chars(ranges):
                return _bytes_of(ranges), False
            case Literal(text) if len(text) == 1:
                return _bytes_of(((ord(text), ord(text)),)), False
            case Plus(body):
                own, run = self.plain(body, names)
                if not run:
                    return own, True
            case Choice(items):
                found = [self.plain(x, names) for x in items]
                if not any(run for _, run in found):
                    return np.logical_or.reduce([own for own, _ in found]), False
        raise _Other


def plan(program: Program) -> Plan | None:
    """How to find the captures of ``program``; None where that takes a matcher."""
    reader = _Reader(program)
    out = reader.plan
    try:
        root, names = reader.open(Ref(program.root), ())
        if program.columns or not (isinstance(root, Seq) and len(root.items) == 2 and root.items[1] == EOF):
            return None
        turns, names = reader.open(root.items[0], names)
        if not isinstance(turns, Star):
            return None
        body, names = reader.open(turns.body, names)
        if not isinstance(body, Catch):
            return out if reader.ways(body, names, 0).all() and not any(x.kind == "recovery" for x in out.nodes) else None
        taken = reader.ways(body.body, names, 0)
        if not (isinstance(body.rescue, Capture) and isinstance(body.rescue.body, Any)) or any(x.kind == "recovery" for x in out.nodes):
            return None
        out.nodes.append(Node(body.rescue.kind, ~taken, False, 0, True))
        out.label, out.rule_stack = body.label, list(names)
        return out
    except _Other:
        return None


def valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def captures(own: Plan, data: np.ndarray, docs: np.ndarray) -> Found:
    """Captures in the bytes ``data`` of documents that end where the next begins, at ``docs`` (the last: their end)."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    # where a character begins; the end of all is one
    head = np.ones(n + 1, bool)
    head[:n] = (data & 0xC0) != 0x80
    wide = not head.all()
    starts, ends, nodes = [], [], []
    for i, node in enumerate(own.nodes):
        inside = node.inside[data]
        if node.run:
            opens = inside & first[:n]
            opens[1:] |= inside[1:] & ~inside[:-1]
            closes = inside & first[1:]
            closes[:-1] |= inside[:-1] & ~inside[1:]
            a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        else:
            a = np.flatnonzero(inside & head[:n])
            if wide:
                heads = np.flatnonzero(head)
                b = heads[np.searchsorted(heads, a) + 1]
            else:
                b = a + 1
        starts.append(a)
        ends.append(b)
        nodes.append(np.full(len(a), i, np.int32))
    start, end, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, nodes))
    depths = np.array([x.depth for x in own.nodes], np.int64)
    levels = int(depths.max()) + 1 if len(depths) else 1
    order = np.argsort(start * levels + depths[node], kind="stable")
    start, end, node = start[order], end[order], node[order]
    bounds = np.searchsorted(start, docs)
    counts = np.diff(bounds)
    parent = np.full(len(start), -1, np.int64)
    depth = depths[node]
    index = np.arange(len(start))
    for level in range(1, levels):
        around = np.maximum.accumulate(np.where(depth == level - 1, index, -1))
        parent = np.where(depth == level, around, parent)
    parent = np.where(parent >= 0, parent - np.repeat(bounds[:-1], counts), -1)
    shift = np.repeat(docs[:-1], counts)
    return Found(node, start - shift, end - shift, parent, bounds)


def tiles(own: Plan, found: Found, data: np.ndarray, docs: np.ndarray):
    """(start, end, node or -1, index of the capture in its document or -1, bounds) of the pieces by innermost capture."""
    counts = np.diff(found.bounds)
    shift = np.repeat(docs[:-1], counts)
    start, end = found.start + shift, found.end + shift
    mark = np.zeros(len(data) + 1, bool)  # numpy's unique hashes every edge and then sorts them
    mark[start] = mark[end] = mark[docs] = True
    edges = np.flatnonzero(mark)
    at, to = edges[:-1], edges[1:]
    of_byte = np.full(256, -1, np.int64)
    for level in range(max((x.depth for x in own.nodes), default=-1) + 1):
        for i, x in enumerate(own.nodes):
            if x.depth == level:
                of_byte[x.inside] = i
    node = of_byte[data[at]]
    depths = np.array([x.depth for x in own.nodes] + [-1], np.int64)
    capture = np.full(len(at), -1, np.int64)
    for level in range(max(depths) + 1):
        own_level = np.flatnonzero(depths[found.node] == level)
        here = depths[node] == level
        if here.any():
            capture[here] = own_level[np.searchsorted(start[own_level], at[here], "right") - 1]
    doc = np.searchsorted(docs, at, "right") - 1
    capture = np.where(capture >= 0, capture - found.bounds[doc], -1)
    return at - docs[doc], to - docs[doc], node, capture, np.searchsorted(at, docs)


def islands(own: Plan, found: Found):
    """(first, last, start, end, bounds) of the runs of adjacent recovery captures; every one has a diagnostic."""
    is_recovery = np.array([x.kind == "recovery" for x in own.nodes] or [False])
    at = np.flatnonzero(is_recovery[found.node])
    doc = np.searchsorted(found.bounds, at, "right") - 1
    own_index = at - found.bounds[doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (found.start[at[1:]] != found.end[at[:-1]]) | (doc[1:] != doc[:-1])
    last = np.ones(len(at), bool)
    last[:-1] = new[1:]
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    return own_index[a], own_index[b], found.start[at[a]], found.end[at[b]], np.searchsorted(at[a], found.bounds)
