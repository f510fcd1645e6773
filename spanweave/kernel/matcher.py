"""Matching a program against a document.

Every pattern becomes a Python closure ``(state, position) -> position or -1``; Python calls among them need no C
stack, so depth is bounded by memory alone.  What a match captures is a chain of immutable cells, so that giving up a
branch, taking a snapshot at the farthest failure and splicing after a rescue are all a change of one reference.

There are two builds of each program.  The plain one fuses patterns without captures into regular expressions with
possessive quantifiers and keeps no record of failures.  It is tried first; if the document doesn't match as a whole,
or a rescue is needed, or the bytes are malformed, the traced build runs instead, which follows every character and
knows the farthest place that was reached.  Both give the same captures where the plain one succeeds.

Memory: failures of rules are kept, successes of at least ``LONG`` bytes, and left-recursive results.  A kept success
is its end and the two ends of its chain of cells, whatever it holds; the cells between are listed when it is used
again.  All of it lives for one document.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from ..grammar.patterns import And, Any, Capture, Catch, Chars, Choice, Column, Literal, Not, Opt, Pattern, Plus, Ref, Seq, Star
from ..grammar.program import Program
from .units import BAD, decoded

LONG = 128
_DEEP = 2_000_000
#: Longest regular expression that a pattern is fused into.
_FUSED = 4000

# Kinds of cells: (previous, kind of cell, ...)
_OPEN, _CLOSE, _BAD, _NOTE = range(4)


class _Rescue(Exception):
    """The plain build met a failure that a catch must look into."""


@dataclass
class Note:
    """Why a rescue began: where the attempt came to, inside which rules, under which label."""

    capture_index: int
    pos: int
    origin: str
    rule_stack: list[str] = field(default_factory=list)
    label: str | None = None


@dataclass
class Match:
    matched: int
    complete: bool
    #: (kind, start, end) in bytes, parents before children.
    captures: list[tuple[str, int, int]]
    notes: list[Note]


class _State:
    __slots__ = ("text", "n", "offsets", "cells", "far", "far_cells", "far_rules", "rules", "column", "memo", "seeds", "growing")

    def __init__(self, text: str, offsets: list[int] | None):
        self.text, self.n, self.offsets = text, len(text), offsets
        self.cells = None
        self.far, self.far_cells, self.far_rules = 0, None, None
        self.rules = None
        self.column = None
        self.memo: dict = {}
        self.seeds: dict = {}
        self.growing: dict = {}


def _class(ranges) -> str:
    """The inside of a regular expression's set."""
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" if lo != hi else f"\\U{lo:08x}" for lo, hi in ranges)


class Matcher:
    def __init__(self, program: Program, long: int = LONG):
        self.program, self.long = program, long
        self.irregular = self._irregular()
        self.regular: dict[str, str | None] = {}
        self._plain = self._build(False)
        self._traced = self._build(True)

    # regular patterns

    def _irregular(self) -> set[str]:
        """Rules that are recursive, capture, rescue or look at columns, or call one that does."""
        rules = self.program.rules
        calls = {n: {x.name for x in p.walk() if isinstance(x, Ref)} for n, p in rules.items()}
        out = {n for n, p in rules.items() if n in self.program.left_recursive or any(isinstance(x, (Capture, Catch, Column)) for x in p.walk())}
        # What is left after taking away, again and again, rules that call only rules taken away, are cycles and their callers.
        free: set[str] = set()
        while more := {n for n in rules if n not in free and n not in out and calls[n] <= free}:
            free |= more
        return set(rules) - free

    def _regex(self, p: Pattern) -> str | None:
        """A regular expression that matches as ``p`` does; None where there is none of a fair size."""
        match p:
            case Literal(text):
                return re.escape(text)
            case Chars(ranges):
                return f"[{_class(ranges)}]" if ranges else "(?!)"
            case Any():
                return "(?s:.)"
            case Ref(name):
                if name in self.irregular:
                    return None
                if name not in self.regular:
                    self.regular[name] = self._regex(self.program.rules[name])
                return self.regular[name]
            case Seq(items) | Choice(items):
                found = [self._regex(x) for x in items]
                if None in found or sum(map(len, found)) > _FUSED:
                    return None
                return "".join(found) if isinstance(p, Seq) else f"(?>{'|'.join(found)})"
            case Star(body) | Plus(body) | Opt(body) | Not(body) | And(body):
                found = self._regex(body)
                if found is None:
                    return None
                return {Star: "(?>{})*+", Plus: "(?>{})++", Opt: "(?>{})?+", Not: "(?!{})", And: "(?={})"}[type(p)].format(found)
        return None

    # closures

    def _build(self, traced: bool):
        rules: dict = {}
        make = _Builder(self, rules, traced)
        for name, body in self.program.rules.items():
            rules[name] = make.rule(name, body)
        return rules

    def match(self, data: bytes) -> Match:
        text, offsets = decoded(data)
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(_DEEP)
        try:
            if BAD not in text:
                state = _State(text, offsets)
                try:
                    end = self._plain[self.program.root](state, 0)
                    if end >= 0:
                        return self._result(state.cells, end, True, offsets)
                except _Rescue:
                    pass
            state = _State(text, offsets)
            end = self._traced[self.program.root](state, 0)
            if end >= 0:
                return self._result(state.cells, end, True, offsets)
            return self._result(state.far_cells, state.far, False, offsets)
        finally:
            sys.setrecursionlimit(old)

    @staticmethod
    def _result(cells, end: int, complete: bool, offsets: list[int] | None) -> Match:
        at = (lambda i: i) if offsets is None else offsets.__getitem__
        captures: list = []
        notes: list[Note] = []
        stack: list[int] = []
        for cell in _cells(cells, None):
            if cell[1] == _OPEN:
                stack.append(len(captures))
                captures.append([cell[2], cell[3], end])
            elif cell[1] == _CLOSE:
                captures[stack.pop()][2] = cell[2]
            elif cell[1] == _BAD:
                notes.append(Note(len(captures), at(cell[2]), "utf8"))
                captures.append(["recovery", cell[2], cell[3]])
            else:
                pos, label, rules = cell[2:]
                names = []
                while rules is not None:
                    names.append(rules[1])
                    rules = rules[0]
                notes.append(Note(len(captures), at(pos), "grammar", names[::-1], label))
        real = len(captures)
        return Match(at(end), complete, [(k, at(s), at(e)) for k, s, e in captures], [x for x in notes if x.capture_index < real])


def _cells(last, first) -> list:
    """Cells after ``first`` up to ``last``, in order."""
    out = []
    while last is not first:
        out.append(last)
        last = last[0]
    return out[::-1]


def _replayed(cells, delta):
    for c in delta:
        cells = (cells, *c[1:])
    return cells


def _closed(last, first):
    """The chain from ``first`` to ``last`` without captures that are still open."""
    cells = _cells(last, first)
    open_: list[int] = []
    for i, c in enumerate(cells):
        if c[1] == _OPEN:
            open_.append(i)
        elif c[1] == _CLOSE:
            open_.pop()
    if not open_:
        return last
    gone = set(open_)
    return _replayed(first, [c for i, c in enumerate(cells) if i not in gone])


def _bad(state, i: int) -> int:
    """Consume a malformed character; runs of them are one capture."""
    c = state.cells
    if c is not None and c[1] == _BAD and c[3] == i:
        state.cells = (c[0], _BAD, c[2], i + 1)
    else:
        state.cells = (c, _BAD, i, i + 1)
    return i + 1


class _Builder:
    def __init__(self, matcher: Matcher, rules: dict, traced: bool):
        self.matcher, self.program, self.rules, self.traced = matcher, matcher.program, rules, traced

    def __call__(self, p: Pattern):
        if not self.traced and not isinstance(p, Ref):
            found = self.matcher._regex(p)
            if found is not None:
                return self.fused(found)
        return getattr(self, type(p).__name__.lower())(p)

    def fused(self, source: str):
        find = re.compile(source).match

        def run(state, i):
            m = find(state.text, i)
            return m.end() if m else -1

        return run

    def literal(self, p: Literal):
        text, size = p.text, len(p.text)

        def run(state, i):
            if state.text.startswith(text, i):
                return i + size
            k = i
            for c in text:
                if k >= state.n or state.text[k] != c:
                    break
                k += 1
            if k > state.far:
                state.far, state.far_cells, state.far_rules = k, state.cells, state.rules
            return -1

        return run

    def chars(self, p: Chars):
        inside = re.compile(f"[{_class(p.ranges)}]").match if p.ranges else (lambda text, i: None)

        def run(state, i):
            if inside(state.text, i):
                return i + 1
            if i < state.n and state.text[i] == BAD:
                return _bad(state, i)
            if i > state.far:
                state.far, state.far_cells, state.far_rules = i, state.cells, state.rules
            return -1

        return run

    def any(self, p: Any):
        def run(state, i):
            if i < state.n:
                return _bad(state, i) if state.text[i] == BAD else i + 1
            if i > state.far:
                state.far, state.far_cells, state.far_rules = i, state.cells, state.rules
            return -1

        return run

    def seq(self, p: Seq):
        items: list = []
        run_: list[Pattern] = []
        # neighbours that can be fused are fused together, as far as the expression keeps a fair size
        for x in p.items:
            plain = not self.traced and self.matcher._regex(x) is not None
            if run_ and not (plain and self.matcher._regex(Seq((*run_, x))) is not None):
                items.append(self.run(run_))
                run_ = []
            if plain:
                run_.append(x)
            else:
                items.append(self(x))
        if run_:
            items.append(self.run(run_))
        steps = tuple(items)

        def run(state, i):
            for step in steps:
                i = step(state, i)
                if i < 0:
                    return -1
            return i

        return run

    def run(self, parts: list[Pattern]):
        return self(parts[0] if len(parts) == 1 else Seq(tuple(parts)))

    def choice(self, p: Choice):
        ways = tuple(self(x) for x in p.items)

        def run(state, i):
            cells = state.cells
            for way in ways:
                j = way(state, i)
                if j >= 0:
                    return j
                state.cells = cells
            return -1

        return run

    def star(self, p: Star):
        body = self(p.body)

        def run(state, i):
            while True:
                cells = state.cells
                j = body(state, i)
                if j <= i:  # a turn that consumes nothing ends the loop
                    state.cells = cells
                    return i
                i = j

        return run

    def plus(self, p: Plus):
        body = self(p.body)

        def run(state, i):
            j = body(state, i)
            while j > i:
                i = j
                cells = state.cells
                j = body(state, i)
                if j <= i:
                    state.cells = cells
                    return i
            return j

        return run

    def opt(self, p: Opt):
        body = self(p.body)

        def run(state, i):
            cells = state.cells
            j = body(state, i)
            if j >= 0:
                return j
            state.cells = cells
            return i

        return run

    def not_(self, p: Not):
        body = self(p.body)

        def run(state, i):
            cells = state.cells
            j = body(state, i)
            state.cells = cells
            if j < 0:
                return i
            if i > state.far:
                state.far, state.far_cells, state.far_rules = i, cells, state.rules
            return -1

        return run

    def and_(self, p: And):
        body = self(p.body)

        def run(state, i):
            cells = state.cells
            j = body(state, i)
            state.cells = cells
            return i if j >= 0 else -1

        return run

    def capture(self, p: Capture):
        body, kind = self(p.body), p.kind

        def run(state, i):
            state.cells = (state.cells, _OPEN, kind, i)
            j = body(state, i)
            if j >= 0:
                state.cells = (state.cells, _CLOSE, j)
            return j

        return run

    def catch(self, p: Catch):
        body, rescue, label = self(p.body), self(p.rescue), p.label
        if not self.traced:

            def quick(state, i):
                cells = state.cells
                j = body(state, i)
                if j >= 0:
                    return j
                if i < state.n:
                    raise _Rescue
                state.cells = cells
                return rescue(state, i)

            return quick

        def run(state, i):
            outer = state.far, state.far_cells, state.far_rules
            cells = state.cells
            state.far, state.far_cells, state.far_rules = i, cells, state.rules
            j = body(state, i)
            far, far_cells, far_rules = state.far, state.far_cells, state.far_rules
            if j < 0:
                state.cells = (_closed(far_cells, cells), _NOTE, far, label, far_rules)
                state.far_cells = state.cells
                j = rescue(state, far)
            if outer[0] >= state.far:
                state.far, state.far_cells, state.far_rules = outer
            return j

        return run

    def column(self, p: Column):
        body = self(p.body) if p.body else None
        blank = re.compile(r"[ \t]*").match
        how = p.how

        def run(state, i):
            end = blank(state.text, i).end()
            width, outer = end - i, state.column
            if how == "align":
                good = width == outer
            else:
                good = how == "root" or width > outer
            if not good:
                if end > state.far:
                    state.far, state.far_cells, state.far_rules = end, state.cells, state.rules
                return -1
            if body is None:
                return end
            state.column = width
            j = body(state, end)
            state.column = outer
            return j

        return run

    def ref(self, p: Ref):
        rules, name = self.rules, p.name
        if not self.traced:
            found = self.matcher._regex(p)
            if found is not None:
                return self.fused(found)

        def run(state, i):
            return rules[name](state, i)

        return run

    def rule(self, name: str, body: Pattern):
        inner = self(body)
        by_column = name in self.program.columns
        long = self.matcher.long
        if name in self.program.left_recursive:
            return self.growing(name, inner, self.program.left_recursive[name], by_column)

        def run(state, i):
            key = (name, i, state.column) if by_column else (name, i)
            known = state.memo.get(key)
            if known is not None:
                if known == -1:
                    return -1
                state.cells = _replayed(state.cells, _cells(known[1], known[2]))
                if known[0] > state.far:
                    state.far, state.far_cells, state.far_rules = known[0], state.cells, state.rules
                return known[0]
            cells, rules = state.cells, state.rules
            state.rules = (rules, name)
            busy = len(state.growing)
            j = inner(state, i)
            state.rules = rules
            if busy and state.growing and any(at == i for _, at in state.growing):
                return j  # it may depend on a result that still grows
            if j < 0:
                state.memo[key] = -1
            elif (j - i if state.offsets is None else state.offsets[j] - state.offsets[i]) >= long:
                state.memo[key] = (j, state.cells, cells)
            return j

        return run

    def growing(self, name: str, inner, group: int, by_column: bool):
        """A left-recursive rule: its own result at a place starts as a failure and grows while it gets longer."""

        def run(state, i):
            key = (name, i, state.column) if by_column else (name, i)
            known = state.memo.get(key)
            if known is None:
                known = state.seeds.get(key)
            if known is not None:
                if known == -1:
                    return -1
                state.cells = _replayed(state.cells, _cells(known[1], known[2]))
                return known[0]
            cells, rules = state.cells, state.rules
            state.seeds[key] = -1
            mark = (group, i)
            first = mark not in state.growing
            state.growing[mark] = state.growing.get(mark, 0) + 1
            state.rules = (rules, name)
            best, last = -1, None
            while True:
                state.cells = cells
                j = inner(state, i)
                if j <= best:
                    break
                best, last = j, state.cells
                state.seeds[key] = (best, last, cells)
            state.rules = rules
            del state.seeds[key]
            state.growing[mark] -= 1
            if not state.growing[mark]:
                del state.growing[mark]
            if first:
                state.memo[key] = -1 if best < 0 else (best, last, cells)
            state.cells = cells if best < 0 else last
            return best

        return run


for _name in ("not", "and"):
    setattr(_Builder, _name, getattr(_Builder, f"{_name}_"))
