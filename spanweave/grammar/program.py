"""Compiled programs: rules after all rewrites, with what the matcher needs to know about each.

Passes, in order: undefined names and indentation scopes are checked; inferred boundaries become lookaheads or
catches; ``ignore`` is put between the items of non-atomic rules; the word sets are made; word boundaries are added to
reserved and preferred rules; the root is wrapped so that it covers the whole input.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from . import analysis
from .notation import SYNTHESIZED, Grammar, GrammarError, folded, parse
from .patterns import EOF, And, Any, Capture, Catch, Chars, Choice, Column, Inferred, Literal, Not, Opt, Pattern, Plus, Ref, Seq, Star, choice, seq, until


class UndefinedRule(GrammarError):
    pass


class WordConflict(GrammarError):
    pass


class ColumnOutOfScope(GrammarError):
    pass


class SoftEnd(GrammarError):
    """A call that can match a prefix in silence, in a grammar that is compiled strictly."""


class MalformedProgram(ValueError):
    """Bytes that no ``encode`` wrote."""


@dataclass
class Program:
    root: str
    rules: dict[str, Pattern]
    left_recursive: dict[str, int] = field(default_factory=dict)
    ignored: set[str] = field(default_factory=set)
    #: Rules whose result depends on the column they are called under.
    columns: set[str] = field(default_factory=set)

    def _all(self, kind: type):
        """Nodes of a kind, the root's first, then by rule name."""
        for name in [self.root, *sorted(n for n in self.rules if n != self.root)]:
            yield from (x for x in self.rules[name].walk() if isinstance(x, kind))

    @property
    def kinds(self) -> list[str]:
        """Kinds of captures in the order in which they are first seen."""
        return list(dict.fromkeys(x.kind for x in self._all(Capture)))

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(x.label for x in self._all(Catch)))

    @property
    def sets(self) -> list[tuple]:
        """Distinct character sets."""
        return list(dict.fromkeys(x.ranges for x in self._all(Chars)))

    @property
    def size(self) -> int:
        """Number of pattern nodes."""
        return sum(1 for p in self.rules.values() for _ in p.walk())


def compiled(source: str, strict: bool = False) -> Program:
    return compile_grammar(parse(source), strict)


def compile_pattern(p: Pattern) -> Program:
    """A program of one pattern without references."""
    if analysis.references(p):
        raise GrammarError("a pattern by itself can't refer to rules")
    return Program("root", {"root": p})


def compile_grammar(grammar: Grammar, strict: bool = False) -> Program:
    """The program of a grammar; a strict one has no findings of the lint."""
    if grammar.root not in grammar.rules:
        raise GrammarError(f"no rule is named {grammar.root}")
    worded = any(r.ascription in SYNTHESIZED for r in grammar.rules.values())
    if worded and "boundary" not in grammar.rules:
        raise UndefinedRule("rules of words need a rule named boundary")
    if missing := analysis.undefined(grammar, SYNTHESIZED):
        raise UndefinedRule(f"{missing[0][0]} refers to {missing[0][1]}, which isn't defined")
    if strict and (found := analysis.lint(grammar)):
        raise SoftEnd(f"{found[0].caller} ends with {found[0].rule}, which can end early: anchor one of them")
    columns = _column_rules(grammar)
    bodies = _anchored(grammar)
    if "ignore" in bodies:
        for name, rule in grammar.rules.items():
            if rule.ascription is None and name not in ("ignore", "boundary"):
                bodies[name] = _spaced(bodies[name])
    hidden = analysis.ignored(grammar)
    _add_words(grammar, bodies)
    pad = [Opt(Ref("ignore"))] if "ignore" in bodies else []
    bodies[grammar.root] = seq([*pad, bodies[grammar.root], *pad, EOF])
    final = Grammar.of(bodies, grammar.root)
    if missing := analysis.undefined(final):
        raise UndefinedRule(f"{missing[0][0]} refers to {missing[0][1]}, which isn't defined")
    return Program(grammar.root, bodies, analysis.left_recursive(final), hidden, columns)


def _column_rules(grammar: Grammar) -> set[str]:
    """Rules that read the column of their caller; the root must not be one."""
    need: set[str] = set()

    def reads(p: Pattern) -> bool:
        match p:
            case Column("root", _):
                return False
            case Column(_, _):
                return True
            case Ref(name):
                return name in need
        return any(reads(x) for x in p.parts())

    while more := {n for n, r in grammar.rules.items() if n not in need and reads(r.body)}:
        need |= more
    if grammar.root in need:
        raise ColumnOutOfScope("%align or %indent is reached without a column: put %root around it")
    return need


def _anchored(grammar: Grammar) -> dict[str, Pattern]:
    """Bodies with inferred boundaries spelt out."""
    if not any(isinstance(x, Inferred) for r in grammar.rules.values() for x in r.body.walk()):
        return {n: r.body for n, r in grammar.rules.items()}
    after = analysis.follow(grammar)

    def change(p: Pattern, name: str) -> Pattern:
        p = p.rebuilt(lambda c: change(c, name))
        if not isinstance(p, Inferred):
            return p
        stop = analysis.boundary_pattern(grammar, after[name])
        held = Seq((p.body, And(stop)))
        return held if p.label is None else Catch(held, p.label, Capture("recovery", until(stop)))

    return {n: change(r.body, n) for n, r in grammar.rules.items()}


def _spaced(p: Pattern) -> Pattern:
    """``ignore`` between the items of sequences and before each turn of a loop; skips stay as they are."""
    gap = Ref("ignore")
    match p:
        case Star(Seq((Not(_), Any()))):
            return p
        case Seq(items):
            out: list[Pattern] = []
            for x in items:
                if out:
                    out.append(gap)
                out.append(_spaced(x))
            return Seq(tuple(out))
        case Star(body):
            return Star(seq([gap, *_flat(_spaced(body))]))
        case Plus(body):
            return Plus(seq([gap, *_flat(_spaced(body))]))
        case Catch(body, label, rescue):
            return Catch(_spaced(body), label, rescue)
    return p.rebuilt(_spaced)


def _flat(p: Pattern) -> tuple[Pattern, ...]:
    return p.items if isinstance(p, Seq) else (p,)


def _add_words(grammar: Grammar, bodies: dict[str, Pattern]) -> None:
    """Make ``reserved`` and ``preferred``, and end the words of such rules at a boundary."""
    sets: dict[str, dict[str, Pattern]] = {k: {} for k in SYNTHESIZED}
    for name, rule in grammar.rules.items():
        if rule.ascription in sets:
            for word, p in _word_patterns(rule.body):
                sets[rule.ascription].setdefault(word, p)
            bodies[name] = _bounded(bodies[name])
    both = sets["reserved"].keys() & sets["preferred"].keys()
    if both:
        raise WordConflict(f"{min(both)} is both reserved and preferred")
    used = {n for p in bodies.values() for n in analysis.references(p)}
    for k, words in sets.items():
        if words or k in used:
            longest = [words[w] for w in sorted(words, key=lambda w: (-len(w), w))]
            bodies[k] = _bounded(choice(longest)) if longest else Not(Literal(""))


def _word_patterns(p: Pattern):
    """(word, pattern) of each word in a choice of words."""
    match p:
        case Capture(_, body):
            yield from _word_patterns(body)
        case Choice(items):
            for x in items:
                yield from _word_patterns(x)
        case _:
            for word in analysis.words_of(p) or ():
                yield word, p if isinstance(p, Literal) else folded(word) if isinstance(p, Seq) else p


def _bounded(p: Pattern) -> Pattern:
    """Each word with a boundary after it, inside of its capture; a choice of plain words tries longer ones first."""
    match p:
        case Capture(kind, body):
            return Capture(kind, _bounded(body))
        case Choice(items):
            if all(isinstance(x, Literal) for x in items):
                items = tuple(sorted(items, key=lambda x: -len(x.text)))
            return Choice(tuple(_bounded(x) for x in items))
    return Seq((*_flat(p), Ref("boundary")))


# --- encoding ---

_MAGIC = b"SPWV1\n"
_NODES = {c.__name__: c for c in (Literal, Chars, Any, Seq, Choice, Star, Plus, Opt, Not, And, Ref, Capture, Catch, Column)}
_SHAPES = {"Literal": ("t",), "Chars": ("r",), "Any": (), "Seq": ("l",), "Choice": ("l",), "Star": ("p",), "Plus": ("p",), "Opt": ("p",), "Not": ("p",), "And": ("p",), "Ref": ("t",), "Capture": ("t", "p"), "Catch": ("p", "t", "p"), "Column": ("t", "o")}


def _out(p: Pattern):
    name = type(p).__name__
    values = [getattr(p, f) for f in p.__dataclass_fields__]
    pack = {"t": lambda v: v, "r": lambda v: [list(r) for r in v], "l": lambda v: [_out(x) for x in v], "p": _out, "o": lambda v: v and _out(v)}
    return [name, *(pack[k](v) for k, v in zip(_SHAPES[name], values, strict=True))]


def _in(x) -> Pattern:
    if not (isinstance(x, list) and x and isinstance(x[0], str) and x[0] in _NODES and len(x) == 1 + len(_SHAPES[x[0]])):
        raise MalformedProgram("no such node")
    values = []
    for k, v in zip(_SHAPES[x[0]], x[1:], strict=True):
        if k == "t" and isinstance(v, str):
            values.append(v)
        elif k == "r" and isinstance(v, list) and all(isinstance(r, list) and len(r) == 2 and all(isinstance(n, int) for n in r) for r in v):
            values.append(tuple((a, b) for a, b in v))
        elif k == "l" and isinstance(v, list):
            values.append(tuple(_in(y) for y in v))
        elif k == "p" or k == "o" and v is not None:
            values.append(_in(v))
        elif k == "o":
            values.append(None)
        else:
            raise MalformedProgram(f"a malformed {x[0]}")
    return _NODES[x[0]](*values)


def encode(program: Program) -> bytes:
    """The same bytes for the same program, with a checksum."""
    body = {"root": program.root, "rules": {n: _out(p) for n, p in sorted(program.rules.items())}, "left": dict(sorted(program.left_recursive.items())), "ignored": sorted(program.ignored), "columns": sorted(program.columns)}
    data = zlib.compress(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode(), 6)
    return _MAGIC + zlib.crc32(data).to_bytes(4, "big") + data


def decode(data: bytes) -> Program:
    if data[: len(_MAGIC)] != _MAGIC:
        raise MalformedProgram("not a program")
    body = data[len(_MAGIC) + 4 :]
    if zlib.crc32(body).to_bytes(4, "big") != data[len(_MAGIC) : len(_MAGIC) + 4]:
        raise MalformedProgram("the checksum is wrong")
    try:
        x = json.loads(zlib.decompress(body))
        rules = {n: _in(p) for n, p in x["rules"].items()}
        program = Program(x["root"], rules, x["left"], set(x["ignored"]), set(x["columns"]))
    except (KeyError, TypeError, AttributeError, ValueError, zlib.error) as e:
        raise MalformedProgram(str(e)) from e
    if program.root not in rules or analysis.undefined(Grammar.of(rules, program.root)):
        raise MalformedProgram("a rule is missing")
    return program
