"""Documents as sequences of code points that remember their byte offsets."""

from __future__ import annotations

import codecs
from itertools import accumulate

#: Stands for one malformed byte sequence; no valid text holds it.
BAD = "\udc80"


def _mark(error: UnicodeDecodeError):
    error.object  # noqa: B018
    _lengths.append(error.end - error.start)
    return BAD, error.end


_lengths: list[int] = []
codecs.register_error("spanweave.mark", _mark)


def decoded(data: bytes) -> tuple[str, list[int] | None]:
    """(text, byte offset of each character and of the end); no offsets are needed for ASCII.

    A maximal malformed prefix is one character, BAD.
    """
    if data.isascii():
        return data.decode("ascii"), None
    _lengths.clear()
    text = data.decode("utf-8", "spanweave.mark")
    bad = iter(list(_lengths))
    sizes = (1 if c < "\x80" else 2 if c < "\u0800" else next(bad) if c == BAD else 3 if c < "\U00010000" else 4 for c in text)
    return text, list(accumulate(sizes, initial=0))
