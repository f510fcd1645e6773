"""One match for all short documents that a program can't tell apart.

A program looks at characters only through its sets, its literals and, where it looks at columns, blanks.  Characters
that lie in the same ones are of one class, and documents whose characters are of the same classes in the same order,
of ASCII alone so that bytes are characters, have the same match: ``{"k": 17}`` and ``{"k": 42}`` under JSON.  Matches of
short documents are kept by that order of classes, their shape, and found again without matching.
"""

from __future__ import annotations

from ..grammar.patterns import Chars, Column, Literal
from ..grammar.program import Program
from .matcher import Match, Matcher

#: Longest document whose match is kept, in bytes.
SHORT = 1024
#: Captures and notes kept in each of two generations; shapes that weren't asked for in a whole one are forgotten.
KEPT = 1 << 18


def classes(program: Program) -> bytes:
    """For each byte the first ASCII one of the same class; a table for ``bytes.translate``."""
    sets: set[tuple] = set()
    for rule in program.rules.values():
        for p in rule.walk():
            if isinstance(p, Chars):
                sets.add(p.ranges)
            elif isinstance(p, Literal):
                sets |= {((ord(c), ord(c)),) for c in p.text}
            elif isinstance(p, Column):
                sets |= {((9, 9),), ((32, 32),)}
    first: dict[tuple, int] = {}
    ordered = sorted(sets)
    of = [first.setdefault(tuple(any(lo <= c <= hi for lo, hi in x) for x in ordered), c) for c in range(128)]
    return bytes(of) + bytes(range(128, 256))


class Shapes:
    """A matcher that remembers the matches of shapes."""

    def __init__(self, matcher: Matcher, kept: int = KEPT):
        self.matcher, self.kept, self.table = matcher, kept, classes(matcher.program)
        self.new: dict[bytes, Match] = {}
        self.old: dict[bytes, Match] = {}
        self.size = 0

    def match(self, data: bytes) -> Match:
        """The match of ``data``; it may be shared, so it is not to be changed."""
        if len(data) > SHORT or not data.isascii():
            return self.matcher.match(data)
        shape = data.translate(self.table)
        found = self.new.get(shape)
        if found is None:
            found = self.old.pop(shape, None)
            if found is None:
                found = self.matcher.match(data)
            self.size += 1 + len(found.captures) + len(found.notes)
            if self.size > self.kept:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[shape] = found
        return found
