"""Which grammar a document is matched under: a name that is given, else the extension of its path, else JSON."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grammar import library

#: Names and extensions of languages that aren't the name of a grammar themselves.
ALIASES = {"sqlite": "sql", "htm": "tags", "html": "tags", "xml": "tags", "jsonl": "json", "txt": "lines", "h": "c", "golang": "go", "js": "javascript", "mjs": "javascript", "rs": "rust", "bzl": "starlark", "star": "starlark", "yml": "yaml"}
DEFAULT = "json"


def by_name(language: Column) -> Column:
    """The grammar of a language's name in either case, null for unknown ones."""
    known = {**{n: n for n in library.NAMES}, **ALIASES}
    return F.try_element_at(F.create_map(*map(F.lit, chain(*known.items()))), F.lower(language))


def by_extension(path: Column) -> Column:
    """The grammar of what stands after the last dot of a path's last part, null without one or for unknown ones."""
    return by_name(F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")))


def grammar_of(path: Column, language: Column | None = None) -> Column:
    """The grammar of a document.  A language that is given but unknown has none: null."""
    other = F.coalesce(by_extension(path), F.lit(DEFAULT))
    return other if language is None else F.when(language.isNotNull(), by_name(language)).otherwise(other)
