"""Patterns as immutable trees.  Sugar of the notation is already lowered to these nodes."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Code points that a set may hold: everything but surrogates.
LAST = 0x10FFFF
_GAP = (0xD800, 0xDFFF)


class Pattern:
    """Base of all nodes."""

    def parts(self) -> tuple[Pattern, ...]:
        """Direct children, in order."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Pattern):
                out.append(v)
            elif isinstance(v, tuple) and v and isinstance(v[0], Pattern):
                out.extend(v)
        return tuple(out)

    def rebuilt(self, change) -> Pattern:
        """This node with ``change`` applied to each child."""
        new = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Pattern):
                new[f.name] = change(v)
            elif isinstance(v, tuple) and v and isinstance(v[0], Pattern):
                new[f.name] = tuple(change(x) for x in v)
            else:
                new[f.name] = v
        return type(self)(**new)

    def walk(self):
        """This node and everything below it."""
        work = [self]
        while work:
            x = work.pop()
            yield x
            work.extend(reversed(x.parts()))


@dataclass(frozen=True)
class Literal(Pattern):
    text: str


@dataclass(frozen=True)
class Chars(Pattern):
    """A set of code points as sorted, disjoint, non-adjacent ranges."""

    ranges: tuple[tuple[int, int], ...]

    def __contains__(self, c: str) -> bool:
        return any(lo <= ord(c) <= hi for lo, hi in self.ranges)


@dataclass(frozen=True)
class Any(Pattern):
    pass


@dataclass(frozen=True)
class Seq(Pattern):
    items: tuple[Pattern, ...]


@dataclass(frozen=True)
class Choice(Pattern):
    items: tuple[Pattern, ...]


@dataclass(frozen=True)
class Star(Pattern):
    body: Pattern


@dataclass(frozen=True)
class Plus(Pattern):
    body: Pattern


@dataclass(frozen=True)
class Opt(Pattern):
    body: Pattern


@dataclass(frozen=True)
class Not(Pattern):
    body: Pattern


@dataclass(frozen=True)
class And(Pattern):
    body: Pattern


@dataclass(frozen=True)
class Ref(Pattern):
    name: str


@dataclass(frozen=True)
class Capture(Pattern):
    kind: str
    body: Pattern


@dataclass(frozen=True)
class Catch(Pattern):
    """``body``; where it fails, ``rescue`` from the farthest place that it reached."""

    body: Pattern
    label: str
    rescue: Pattern


@dataclass(frozen=True)
class Inferred(Pattern):
    """``body`` anchored to what may follow the rule; with a label, a catch that skips there."""

    body: Pattern
    label: str | None


@dataclass(frozen=True)
class Column(Pattern):
    """Indentation: ``root`` seeds the column of ``body``, ``indent`` opens a deeper one, ``align`` asserts it."""

    how: str
    body: Pattern | None = None


def merged(ranges) -> tuple[tuple[int, int], ...]:
    """Sorted ranges with overlapping and adjacent ones joined; surrogates count as adjacent."""
    out: list[list[int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] <= r[1]):
        if out and (lo <= out[-1][1] + 1 or out[-1][1] + 1 >= _GAP[0] and lo <= _GAP[1] + 1):
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((lo, hi) for lo, hi in out)


def negated(ranges) -> tuple[tuple[int, int], ...]:
    out, at = [], 0
    for lo, hi in merged(ranges):
        out.append((at, lo - 1))
        at = hi + 1
    out.append((at, LAST))
    return merged(out)


def united(*sets) -> tuple[tuple[int, int], ...]:
    return merged(r for s in sets for r in s)


def subset(a, b) -> bool:
    return all(any(lo <= x and y <= hi for lo, hi in merged(b)) for x, y in merged(a))


def seq(items) -> Pattern:
    items = tuple(items)
    return items[0] if len(items) == 1 else Seq(items)


def choice(items) -> Pattern:
    items = tuple(items)
    return items[0] if len(items) == 1 else Choice(items)


def until(stop: Pattern) -> Pattern:
    """Everything before ``stop``."""
    return Star(Seq((Not(stop), Any())))


EMPTY = Literal("")
EOF = Not(Any())
