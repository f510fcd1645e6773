"""Captures of regular grammars by built-in functions alone, without Python workers.

A grammar whose root is one loop over a pattern that never fails, such as a lexer, cuts every document into turns
that follow each other without a gap.  The turns are the matches of one Java expression anchored at the end of the
match before (``\\G``), with possessive and atomic groups, since a choice once made is never taken back.  A capture
that stands in a turn outside of inner loops is a group of that expression; the turns of an inner loop are found in the
text of the capture around it, in the same way.

``literals`` says None where a grammar or a capture isn't of this shape: recursion, recoveries, indentation, captures
that may be empty or stand in several places.  ``found`` then asks the matcher.  Which way is taken depends on the
grammar alone.  String columns are taken to be UTF-8, as their type says; binary ones go to the matcher.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grammar import analysis
from ..grammar.patterns import EOF, And, Any, Capture, Chars, Choice, Literal, Not, Opt, Pattern, Plus, Ref, Seq, Star, merged
from ..grammar.program import Program
from . import spans
from .parse import parse_documents, spread

_EVERY = ((0, 0x10FFFF),)


class _Irregular(Exception):
    pass


@dataclass
class Loop:
    """The turns of a loop: an expression, its groups by kind, and the loops that are bodies of captures."""

    regex: str = ""
    groups: dict[str, int] = field(default_factory=dict)
    inner: dict[str, Loop] = field(default_factory=dict)
    several: set[str] = field(default_factory=set)

    def literals(self, text: Column, kind: str) -> Column | None:
        """Texts of all captures of a kind in ``text``, in order."""
        if kind in self.several:
            return None
        if kind in self.groups:
            return F.filter(F.regexp_extract_all(text, F.lit(self.regex), F.lit(self.groups[kind])), lambda x: x != "")
        for outer, loop in self.inner.items():
            if loop.literals(text, kind) is not None:
                return F.flatten(F.transform(self.literals(text, outer), loop.of_kind(kind)))
        return None

    def of_kind(self, kind: str):
        return lambda x: self.literals(x, kind)

    def kinds(self) -> list[str]:
        return [*self.groups, *(k for loop in self.inner.values() for k in loop.kinds())]


class _Writer:
    """Writes the turns of one loop."""

    def __init__(self, program: Program, inside: tuple[str, ...]):
        self.program, self.loop, self.inside = program, Loop(), inside

    def write(self, p: Pattern, top: bool) -> str:
        """``top``: whether a group of ``p`` is taken back when what follows fails; captures may stand only there."""
        match p:
            case Literal(text):
                return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)
            case Chars(ranges):
                return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]" if ranges else "(?!)"
            case Any():
                return "(?s:.)"
            case Ref(name):
                if name in self.inside or name in self.program.left_recursive:
                    raise _Irregular
                self.inside += (name,)
                out = self.write(self.program.rules[name], top)
                self.inside = self.inside[:-1]
                return out
            case Seq(items):
                return "".join(self.write(x, top) for x in items)
            case Choice(items):
                return f"(?>{'|'.join(self.write(x, False) for x in items)})"
            case Star(body) | Plus(body) | Opt(body):
                sign = {Star: "*+", Plus: "++", Opt: "?+"}[type(p)]
                own = self.write(body, False)
                return own + sign if isinstance(body, Chars) and own != "(?!)" else f"(?>{own}){sign}"
            case Not(body) | And(body):
                return f"(?{'!' if isinstance(p, Not) else '='}{self.write(body, False)})"
            case Capture(kind, body):
                return self.capture(kind, body, top)
        raise _Irregular

    def capture(self, kind: str, body: Pattern, top: bool) -> str:
        if not top or analysis.is_nullable(body, analysis.nullable_names(self.program.rules)):
            raise _Irregular
        if kind in self.loop.groups:
            self.loop.several.add(kind)
        self.loop.groups[kind] = len(self.loop.groups) + 1
        if isinstance(body, (Star, Plus)) and any(isinstance(x, Capture) for x in _all(self.program, body.body)):
            self.loop.inner[kind] = turns(self.program, body.body, self.inside)
            return f"({_Bare(self.program, self.inside).write(body, False)})"
        return f"({self.write(body, top)})"


class _Bare(_Writer):
    """Writes a pattern without its captures."""

    def capture(self, kind: str, body: Pattern, top: bool) -> str:
        return self.write(body, top)


def _all(program: Program, p: Pattern, seen: tuple[str, ...] = ()):
    yield p
    if isinstance(p, Ref):
        if p.name in seen:
            raise _Irregular
        yield from _all(program, program.rules[p.name], (*seen, p.name))
    for x in p.parts():
        yield from _all(program, x, seen)


def _open(program: Program, p: Pattern) -> Pattern:
    while isinstance(p, Ref) and p.name not in program.left_recursive:
        p = program.rules[p.name]
    return p


def turns(program: Program, body: Pattern, inside: tuple[str, ...] = ()) -> Loop:
    """The loop whose turns match ``body``; captures may stand in its alternatives."""
    if analysis.is_nullable(body, analysis.nullable_names(program.rules)):
        raise _Irregular
    writer = _Writer(program, inside)
    ways = _open(program, body)
    ways = ways.items if isinstance(ways, Choice) else (body,)
    writer.loop.regex = f"\\G(?>{'|'.join(writer.write(x, True) for x in ways)})"
    if writer.loop.several or len(set(writer.loop.kinds())) < len(writer.loop.kinds()):
        raise _Irregular
    return writer.loop


def _sure(program: Program, p: Pattern) -> tuple:
    """Characters that are enough for ``p`` to match wherever one of them comes next."""
    match p:
        case Any():
            return _EVERY
        case Literal(text):
            return ((ord(text), ord(text)),) if len(text) == 1 else ()
        case Chars(ranges):
            return tuple(ranges)
        case Ref(name):
            return _sure(program, program.rules[name])
        case Plus(body) | Capture(_, body):
            return _sure(program, body)
        case Choice(items):
            return tuple(merged([r for x in items for r in _sure(program, x)]))
    return ()


def loop(program: Program) -> Loop | None:
    """The loop that the program is, if it is one that matches every document as a whole."""
    root = program.rules[program.root]
    if not (isinstance(root, Seq) and len(root.items) == 2 and isinstance(root.items[0], Star) and root.items[1] == EOF):
        return None
    try:
        out = turns(program, root.items[0].body)
        sure = tuple(merged(list(_sure(program, root.items[0].body))))
    except (_Irregular, RecursionError):
        return None
    at = 0
    for a, b in sure:  # surrogates are no characters
        if a > at and not (at >= 0xD800 and a <= 0xE000):
            return None
        at = max(at, b + 1)
    return out if at > 0x10FFFF else None


def literals(program: Program, text: str | Column, kind: str) -> Column | None:
    """Texts of all captures of ``kind``, or None where only the matcher can tell."""
    own = loop(program)
    text = F.col(text) if isinstance(text, str) else text
    return None if own is None else own.literals(F.coalesce(text, F.lit("")), kind)


def nested(program: Program, text: str, outer: str, kind: str) -> Column | None:
    """For each capture of ``outer``, the texts of those of ``kind`` in it."""
    own = loop(program)
    if own is None or outer not in own.inner or kind not in own.inner[outer].groups:
        return None
    return F.transform(own.literals(F.coalesce(F.col(text), F.lit("")), outer), lambda x: own.inner[outer].literals(x, kind))


def found(df: DataFrame, program: Program, payload: str, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``literals``, the texts of all captures of ``kind`` in each document, by the shorter way."""
    made = literals(program, payload, kind) if dict(df.dtypes)[payload] == "string" else None
    if made is not None:
        return spread(df.select(*keep, *([payload] if payload not in keep else []))).select(*keep, made.alias("literals"))
    kept = list(dict.fromkeys([*keep, payload]))
    parsed = parse_documents(df, program, payload, kept)
    cut = F.transform(F.filter("captures", lambda c: c.kind == kind), lambda c: spans.literal(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), c.start, c.end))
    return parsed.select(*keep, cut.alias("literals"))
