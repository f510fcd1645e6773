"""Secret scans with a worklist that unwraps nested encodings.

Base kinds are found in the text as it is: ``assign``, ``access`` and ``hex``.  Then the text with its URL escapes
decoded, the text with its Unicode escapes decoded and base64 runs become layers, each run by itself and
neighbouring lines joined; base64 that holds gzip, zlib, bzip2, xz or zstd data is decompressed, all members of it.  Each new layer is
scanned and searched for further layers, until nothing new appears; a layer whose text and place were seen before ends
there, so that cycles stop.  A find in a layer is mapped back to the original characters that it came from (one escape
a character; base64 as a whole run) and reported as ``decoded_<kind>``, unless a base span of its kind lies there.

Offsets are code points, ends exclusive.  Spans are ordered by start, then by kind as in ``KINDS``.

Edge cases.  A null text is an empty one: no spans.  An empty table gives none, rows that repeat a doc_id keep a row
each, other columns are ignored.  Texts are scanned whole, one unbroken run too.  Data that are no text, or only in part, are scanned all the same: as
Latin-1, and as UTF-16 where that fits.  A layer of more than ``LAYER_BYTES`` is unpacked in pieces and scanned in
windows that overlap, whatever it unpacks to.  Only where base64 lines of more than ``LAYER_BYTES`` stand inside such a
layer are they scanned in parts; this is reported as ``oversize``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .bytescan import Texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(f"decoded_{k}" for k in BASE), "oversize")
#: A longer layer is scanned in windows of this many new bytes.
LAYER_BYTES = 64 << 20
#: Bytes that are unpacked at once.
PIECE_BYTES = 1 << 20
#: Bytes at least that a window of a long layer shares with the window before.
OVERLAP_BYTES = 64 << 10
RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN)
#: Base64 lines below each other, the last one perhaps short; a line end may be written as an escape.
_LINE_END = re.compile(r"[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t>]*")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:%s[A-Za-z0-9+/_-]{%d,})*(?:%s[A-Za-z0-9+/_-]+)?={0,2}" % (RUN, _LINE_END.pattern, RUN, _LINE_END.pattern))
#: ASCII in UTF-16; big-endian text is little-endian one byte later.
_WIDE = re.compile(rb"(?:[\x09-\x7e]\x00){8,}")
#: What base64 lines are made of, line ends that are written as escapes included.
_LINE_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\\\r"
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
_HEXES, _RUNS = np.zeros(256, bool), np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_RUNS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True

Span = tuple[str, int, int]
#: Starts of a layer's pieces; starts and ends of what they come from, the end None where a piece is taken as it is.
Pieces = tuple[list[int], list[int], list[int | None]]


def base_spans(text: str, hexes: bool = True) -> list[Span]:
    """The base kinds, leftmost and non-overlapping by kind; ``hexes``: whether a hex run can be there."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _opened(data: bytes):
    """An unpacker for data that begins as packed data do."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class _Source(io.RawIOBase):
    """What is left of a stream of bytes, as a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def read(self, n: int = -1) -> bytes:
        self.held = self.held or next((x for x in self.pieces if x), b"")
        out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
        return out


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of packed data unpack to, in bounded pieces, and what follows them as it is; ends where the data are broken."""
    source = _Source(pieces)
    data = b""
    while True:
        while len(data) < 6 and (more := source.read()):
            data += more
        if not data:
            return
        try:
            if data[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                source.held = data + source.held
                with zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True) as reader:
                    while out := reader.read(PIECE_BYTES):
                        yield out
                return
            unzip = _opened(data)
            if unzip is None:
                while data:
                    yield data
                    data = source.read()
                return
            deflate = not hasattr(unzip, "needs_input")
            while not unzip.eof:
                out = unzip.decompress(data, PIECE_BYTES)
                data = unzip.unconsumed_tail if deflate else b""
                if out:
                    yield out
                elif not data and not unzip.eof and not (data := source.read()):
                    return
            data = unzip.unused_data
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        except Exception as e:  # zstandard has an error class of its own
            if type(e).__name__ == "ZstdError":
                return
            raise


def _packed(data: bytes) -> bool:
    return data[:4] == b"\x28\xb5\x2f\xfd" or _opened(data) is not None


def _first(pieces: Iterator[bytes], least: int) -> bytes:
    """The first bytes of a stream, ``least`` or a piece more, or all where it ends before."""
    out, n = [], 0
    for piece in pieces:
        out.append(piece)
        n += len(piece)
        if n >= least:
            break
    return b"".join(out)


def _texts(data: bytes) -> Iterator[str]:
    """The data as Latin-1 (all that is looked for is ASCII), and as UTF-16 where that fits, at even or odd bytes."""
    yield data.decode("latin-1")
    for odd in sorted({m.start() % 2 for m in _WIDE.finditer(data)}):
        yield data[odd:].decode("utf-16-le", "replace")


def _base64_layer(run: str) -> Iterator[str | None]:
    """The texts in a run, long ones in windows; None where base64 lines in it had to be cut."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return
    for window in _windows(_unpacked(data)):
        if window is None:
            yield None
        else:
            yield from _texts(window)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """What packed data hold, unpacked again while that is packed too, in pieces; other data as they are."""
    pieces: Iterator[bytes] = iter([data])
    seen = set()
    while True:
        head = _first(pieces, LAYER_BYTES)
        key = hashlib.blake2b(head, digest_size=16).digest()
        if key in seen or not _packed(head):
            return chain([head], pieces)
        seen.add(key)
        inner = _members(chain([head], pieces))
        first = next(inner, b"")
        if not first:
            return chain([head], pieces)
        pieces = chain([first], inner)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes | None]:
    """The pieces joined to windows of about LAYER_BYTES.

    A window begins with the end of the one before: OVERLAP_BYTES of it, or all of the base64 lines that were still
    going on.  None where these were longer than LAYER_BYTES and had to be cut.
    """
    held: list[bytes] = []
    new = 0
    for piece in pieces:
        held.append(piece)
        new += len(piece)
        if new <= LAYER_BYTES:
            continue
        window = b"".join(held)
        yield window
        keep = max(len(window) - _open_from(window), OVERLAP_BYTES)
        if keep > LAYER_BYTES:
            yield None
            keep = OVERLAP_BYTES
        held = [window[-keep:]]
        new = 0
    if new:
        yield b"".join(held)


def _open_from(data: bytes) -> int:
    """Where the base64 lines begin that may go on after the data."""
    end = len(data)
    while end >= 0:
        begin = data.rfind(b"\n", 0, end) + 1
        line = data[begin:end].rstrip(b" \t\r")
        if not line and (end < len(data) or end - begin > OVERLAP_BYTES):
            return min(end + 1, len(data))
        rest = line.rstrip(_LINE_BYTES)
        if rest.strip(b" \t>"):
            return begin + len(rest)
        end = begin - 1
    return 0


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run): each base64 run, and neighbouring lines joined as one run.

    Lines of one width go together, also with the line before them (whose beginning may be other text) and with the
    shorter one after them; and so do all lines that follow one another.
    """
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
    for m in _WRAPPED.finditer(text) if "\n" in text or "\r" in text or "\\n" in text else ():
        breaks = [x.span() for x in _LINE_END.finditer(text, m.start(), m.end())]
        if not breaks:
            continue
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()], strict=True))
        groups, i, n = {(0, len(lines))}, 0, len(lines)
        while i < n:
            k = i + 1
            while k < n and lines[k][1] - lines[k][0] == lines[i][1] - lines[i][0]:
                k += 1
            groups |= {(a, b) for a in (i, max(i - 1, 0)) for b in (k, min(k + 1, n)) if b - a > 1}
            i = k
        for a, b in sorted(groups):
            yield lines[a][0], lines[b - 1][1], "".join(text[x:y] for x, y in lines[a:b])


def _escapes(text: str, url: bool) -> tuple[str, Pieces] | None:
    """The whole text with its escapes decoded, and where its pieces come from; None where it has no escapes."""
    parts: list[str] = []
    at: list[int] = []
    begin: list[int] = []
    end: list[int | None] = []
    n = done = 0

    def add(part: str, a: int, b: int | None):
        nonlocal n
        parts.append(part), at.append(n), begin.append(a), end.append(b)
        n += len(part)

    for m in (_URL if url else _UNICODE).finditer(text):
        if done < m.start():
            add(text[done : m.start()], done, None)
        done = m.end()
        if not url:
            code = int(m[1] or m[2] or m[3], 16)
            add(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", m.start(), m.end())
            continue
        data, i = bytes.fromhex(m[0].replace("%", "")), 0
        while i < len(data):
            k = next((k for k in (1, 2, 3, 4) if _valid(data[i : i + k])), 0)
            add(data[i : i + k].decode() if k else "\ufffd", m.start() + 3 * i, m.start() + 3 * (i + max(k, 1)))
            i += max(k, 1)
    if not done:
        return None
    if done < len(text):
        add(text[done:], done, None)
    return "".join(parts), (at, begin, end)


def _place(origin, start: int, end: int) -> tuple[int, int]:
    """Where a part of a layer comes from in the original text; ``origin``: (pieces, origin of the layer around it) or None."""
    while origin is not None:
        (at, begins, ends), origin = origin
        i, k = bisect_right(at, start) - 1, bisect_right(at, end - 1) - 1
        start, end = begins[i] + (start - at[i] if ends[i] is None else 0), begins[k] + end - at[k] if ends[k] is None else ends[k]
    return start, end


def _valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _layers(text: str):
    """(layer, pieces): the texts that are wrapped in ``text``; None stands for base64 lines that had to be cut."""
    for sign, url in (("%", True), ("\\", False)):
        if sign in text and (decoded := _escapes(text, url)):
            yield decoded
    for start, end, run in _base64_runs(text):
        for layer in _base64_layer(run):
            yield layer, ([0], [start], [end])


def scan(text: str, hexes: bool = True, runs: bool = True) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans).  ``hexes`` and ``runs``: whether hex or base64 runs can be in the text."""
    base = base_spans(text, hexes)
    found = set(base)
    if not (runs or "%" in text or "\\" in text):
        return base, list(base)
    places = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in BASE}
    work, seen = [(text, None, _layers(text))], set()
    while work:  # depth first, so that no more than one window of a layer is held
        layer, origin, inners = work[-1]
        for inner, pieces in inners:
            where = (pieces, origin)
            if inner is None:
                found.add(("oversize", *_place(where, 0, 1)))
                continue
            if not inner or inner == layer:
                continue
            key = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), _place(where, 0, len(inner)))
            if key in seen:
                continue
            seen.add(key)
            for kind, s, e in base_spans(inner):
                a, b = _place(where, s, e)
                own = places[kind]
                k = bisect_left(own, (b, -1))
                if not (k and own[k - 1][1] > a):
                    found.add((f"decoded_{kind}", a, b))
            work.append((inner, where, _layers(inner)))
            break
        else:
            work.pop()
    return base, list(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in _ordered(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _has_run(texts: Texts, kinds: np.ndarray, least: int) -> np.ndarray:
    """Which texts have ``least`` bytes of a kind in a row."""
    inside = np.concatenate([[False], kinds[texts.data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    long = edges[1::2] - edges[::2] >= least  # a run across two texts only costs a search for nothing
    out = np.zeros(len(texts) + 1, bool)
    if long.any():
        first, last = texts.owners(edges[::2][long]), texts.owners(edges[1::2][long] - 1)
        out[first] = out[last] = True
    return out


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest and all spans, one row a document; map-only."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, texts):
        whole = Texts.of(texts)
        hexes, runs = _has_run(whole, _HEXES, 16), _has_run(whole, _RUNS, RUN)
        rows = [scan(t, bool(hexes[i]), bool(runs[i])) for i, t in enumerate(texts.to_pylist())]
        counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in BASE]
        digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
        columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([written(own) for _, own in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return store.map_slices(docs, "text", work, SCHEMA)
