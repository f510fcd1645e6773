"""Literals for display: cut short, quoted, coloured.  Built-in functions alone; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ANSI escapes of capture kinds; any other kind has none.
COLOURS = {
    "keyword": "\x1b[1;34m",
    "string": "\x1b[32m",
    "number": "\x1b[33m",
    "comment": "\x1b[2;37m",
    "operator": "\x1b[36m",
    "punctuation": "\x1b[37m",
    "type": "\x1b[33m",
    "function": "\x1b[1;33m",
    "constant": "\x1b[35m",
    "property": "\x1b[36m",
    "variable": "\x1b[37m",
    "recovery": "",
}
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8 that end with a whole character, and an ellipsis if something is left out."""
    data = text.cast("binary")
    # A character has four bytes at most, so that one of these places is the start of one.
    ends = [F.when(~F.hex(data.substr(end + 1, 1)).between("80", "BF"), F.lit(end)) for end in range(most, max(most - 4, -1), -1)]
    cut = F.decode(data.substr(F.lit(1), F.coalesce(*ends, F.lit(0))), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def quoted(text: Column) -> Column:
    """A JSON string; control characters and DEL are escaped, so that a terminal never sees them."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in map(chr, [*range(32), 127]):
        out = F.replace(out, F.lit(c), F.lit(_SHORT.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f\x7f"\\]'), out).otherwise(text), F.lit('"'))


def colour(kind: Column) -> Column:
    """The ANSI escape of a kind, empty for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(known, kind), F.lit("")))
