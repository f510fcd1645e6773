"""Shipped grammars: the source and the compiled program of each by name."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from ..program import Program, compiled

NAMES = ("c", "css", "go", "javascript", "json", "lines", "rust", "sql", "starlark", "tags", "toml", "words", "yaml")


def source(name: str) -> str:
    if name not in NAMES:
        raise KeyError(f"no grammar is named {name}")
    return files(__package__).joinpath(f"{name}.peg").read_text()


@cache
def program(name: str) -> Program:
    return compiled(source(name))
