"""Word and line spans of a whole slice of texts at once, as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All of these are ASCII, so a byte span is a
character span too.  Hashes are 64 bits: equal spans have equal hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Eight-byte pieces of long spans that are hashed at once.
_PIECES = 1 << 18
#: Pieces that are hashed with those of the same place in all other spans; most words have no more.
_SHORT = 2
#: Pieces after which spans are compared one by one.
_LONG = 16
#: Spans whose arrays stay in a core's cache.
_AT_ONCE = 1 << 13
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Texts:
    """``data``: bytes of all texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position is in."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def lowered(self) -> Texts:
        """A-Z as a-z; nothing else changes."""
        return Texts(LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all words."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        full = ~SPACE[self.data]
        begin = full.copy()
        begin[1:] &= ~full[:-1] | edge[1:-1]
        close = full.copy()
        close[:-1] &= ~full[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
        return starts, ends, np.repeat(np.arange(len(self)), np.diff(np.searchsorted(starts, self.offsets)))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all lines split at line feeds; an empty text has one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        n = len(self)
        starts = np.concatenate([self.offsets[:-1], feeds + 1])
        docs = np.concatenate([np.arange(n), self.owners(feeds)])
        order = np.lexsort((starts, docs))
        starts, docs = starts[order], docs[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.ones(len(starts), bool)
        last[:-1] = docs[1:] != docs[:-1]
        ends[last] = self.offsets[1:][docs[last]]
        return starts, ends, docs

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span; spans are ascending and don't overlap."""
        return span_hashes(self.data, starts, ends)


def _eights(data: np.ndarray) -> np.ndarray:
    """``data`` as little-endian 64-bit words, with zeros to spare at the end."""
    return np.frombuffer(data.tobytes() + bytes(24 - len(data) % 8), "<u8")


def _piece(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each position on, of which ``left`` belong to the span; the others are zeros."""
    low = words[at >> 3]
    high = words[(at >> 3) + 1]
    shift = ((at & 7) << 3).astype(U64)
    value = (low >> shift) | ((high << U64(1)) << (U64(63) - shift))
    return value & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) << 3).astype(U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each span: the sum of its eight-byte pieces, each mixed with its place in the span, and the length.

    ``mix`` is no polynomial of the letters, so that texts of regular structure (periodic, self-similar) have no
    hashes in common; two different spans share one by chance alone.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    words = _eights(data)
    parts = [_hashes(words, starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE]) for i in range(0, len(starts), _AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def _hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    total = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    live = np.flatnonzero(size > 0)
    for k in range(_SHORT):
        left = size[live] - 8 * k
        total[live] += mix(_piece(words, starts[live] + 8 * k, left) ^ _place(k))
        live = live[left > 8]
    more = (size[live] + 7) // 8 - _SHORT
    until = np.cumsum(more)
    i = 0
    while i < len(live):  # the rest of long spans, as many at once as have _PIECES pieces
        j = max(i + 1, int(np.searchsorted(until, until[i] - more[i] + _PIECES, "right")))
        if more[i] > _PIECES:
            for k in range(_SHORT, _SHORT + int(more[i]), _PIECES):
                total[live[i]] += _pieces(words, starts[live[i : i + 1]], size[live[i : i + 1]], np.arange(k, min(k + _PIECES, _SHORT + more[i]))).sum(dtype=U64)
        else:
            own = np.repeat(live[i:j], more[i:j])
            k = np.arange(len(own)) - np.repeat(until[i:j] - more[i:j] - (until[i] - more[i]), more[i:j]) + _SHORT
            total[live[i:j]] += np.add.reduceat(_pieces(words, starts[own], size[own], k), until[i:j] - more[i:j] - (until[i] - more[i]))
        i = j
    return mix(total)


def _pieces(words: np.ndarray, start: np.ndarray, size: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix(_piece(words, start + 8 * k, size - 8 * k) ^ _place(k))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> bool:
    """Whether spans with equal hashes, at the same places in the two lists, have the very same bytes.

    Of spans of one length up to eight bytes that is certain: ``mix`` maps different pieces to different values.
    """
    size = ends - starts
    if not np.array_equal(size, other_ends - other_starts):
        return False
    long = np.flatnonzero(size > 8)
    if not len(long):
        return True
    one, two = _eights(data), _eights(other) if other is not data else None
    two = one if two is None else two
    for i in range(0, len(long), _AT_ONCE):
        live = long[i : i + _AT_ONCE]
        for k in range(_LONG):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            left = size[live] - 8 * k
            if not np.array_equal(_piece(one, starts[live] + 8 * k, left), _piece(two, other_starts[live] + 8 * k, left)):
                return False
        for j in live[size[live] > 8 * _LONG].tolist():
            if not np.array_equal(data[starts[j] : ends[j]], other[other_starts[j] : other_ends[j]]):
                return False
    return True


def _place(k: int | np.ndarray) -> np.ndarray:
    return mix((np.atleast_1d(k).astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def grams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words that lie in one text, and the place of their first words."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    places = np.flatnonzero(docs[n - 1 :] == docs[: len(docs) - n + 1])
    total = np.zeros(len(places), U64)
    for k in range(n):
        total = mix(total * U64(0xC2B2AE3D27D4EB4F) + hashes[places + k] + U64(k + 1))
    return total, places


def prefix(flags: np.ndarray) -> np.ndarray:
    """Running count with a leading zero: ``prefix(f)[e] - prefix(f)[s]`` counts ``f`` in a span."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out
