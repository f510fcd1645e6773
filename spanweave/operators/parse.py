"""Matching a column of documents: one row in, one row out, with the captures as an array.

The program (kilobytes, the same for all rows) travels with the task, each Python worker builds its matcher once, and
rows come in Arrow batches.  Nothing is moved but the documents, dealt over the cores.  A null payload counts as an
empty document.  Grammars of runs (``kernel.runs``) take no matcher; short documents of one shape share a match
(``kernel.shapes``).
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..grammar import program as programs
from ..grammar.program import Program
from ..kernel import runs
from ..kernel.matcher import Match, Matcher
from ..kernel.shapes import Shapes

#: Bytes of documents matched before their captures are handed on; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of a part when documents are dealt out before they are matched, by the optimizer's estimate; parts a core, at least and at most.
PART_BYTES = 4 << 20
PARTS = (4, 64)
CAPTURES = "array<struct<kind:string,start:long,end:long,depth:int,parent:int>>"
NOTES = "array<struct<capture_index:int,pos:long,origin:string,rule_stack:array<string>,label:string>>"
#: Maximal runs of recovery captures, with the diagnostic that came farthest in each; ``told`` is false without one.
ISLANDS = "array<struct<first:int,last:int,start:long,end:long,rule_stack:array<string>,label:string,told:boolean>>"
TILES = "array<struct<start:long,end:long,kind:string,capture_idx:int>>"
PARSED = f"n_bytes long, matched long, complete boolean, captures {CAPTURES}, notes {NOTES}"

_STRINGS = pa.list_(pa.string())
_ARROW = {
    "captures": pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("parent", pa.int32())]),
    "notes": pa.struct([("capture_index", pa.int32()), ("pos", pa.int64()), ("origin", pa.string()), ("rule_stack", _STRINGS), ("label", pa.string())]),
    "islands": pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("rule_stack", _STRINGS), ("label", pa.string()), ("told", pa.bool_())]),
    "tiles": pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("capture_idx", pa.int32())]),
}


@lru_cache(16)
def _matcher(data: bytes) -> Shapes:
    return Shapes(Matcher(programs.decode(data)))


@lru_cache(16)
def _plan(data: bytes) -> runs.Plan | None:
    return runs.plan(programs.decode(data))


def nesting(captures: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(depth, index of the parent or -1) of each capture; one that ends at or before a start is closed there."""
    out, open_ = [], []
    for i, (_, start, _) in enumerate(captures):
        while open_ and captures[open_[-1]][2] <= start:
            open_.pop()
        out.append((len(open_), open_[-1] if open_ else -1))
        open_.append(i)
    return out


def tiles(captures: list[tuple[str, int, int]], n_bytes: int) -> list[tuple[int, int, str | None, int]]:
    """Non-empty pieces of ``0..n_bytes`` by innermost capture, in order; None and -1 where there is none."""
    out: list = []
    at, open_ = 0, []

    def piece(end: int) -> None:
        nonlocal at
        if end > at:
            i = open_[-1] if open_ else -1
            out.append((at, end, captures[i][0] if i >= 0 else None, i))
            at = end

    for i, (_, start, _) in enumerate(captures):
        while open_ and captures[open_[-1]][2] <= start:
            piece(captures[open_[-1]][2])
            open_.pop()
        piece(start)
        open_.append(i)
    while open_:
        piece(captures[open_[-1]][2])
        open_.pop()
    piece(n_bytes)
    return out


def islands(captures: list[tuple[str, int, int]], notes: list) -> list[tuple]:
    """Runs of consecutive recovery captures each of which starts where the one before ends, in order; of the
    diagnostics of their captures the farthest, the first of equals."""
    told: dict[int, list] = {}
    for x in notes:
        told.setdefault(x.capture_index, []).append(x)
    out: list = []
    best = None
    for i, (kind, start, end) in enumerate(captures):
        if kind != "recovery":
            continue
        if not (out and out[-1][1] == i - 1 and out[-1][3] == start):
            out.append([i, i, start, end, None, None, False])
            best = None
        out[-1][1], out[-1][3] = i, end
        for x in told.get(i, ()):
            if best is None or x.pos > best:
                best = x.pos
                out[-1][4:] = x.rule_stack, x.label, True
    return [tuple(x) for x in out]


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    sizes = [0]
    for r in rows:
        sizes.append(sizes[-1] + len(r))
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * kind.num_fields
    made = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kind)))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > SLICE_BYTES:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _new(with_tiles: bool, with_islands: bool, only: Collection[str] | None = None) -> list[str]:
    """The names of the new columns, in order."""
    every = ["n_bytes", "matched", "complete", "captures", "notes"] + ["islands"] * with_islands + ["tiles"] * with_tiles
    if only is not None and (unknown := set(only).difference(every)):
        raise ValueError(f"no columns {sorted(unknown)}")
    return [x for x in every if only is None or x in only]


def _columns(docs: list[bytes], found: list[Match], with_tiles: bool, with_islands: bool, only: Collection[str] | None = None) -> list[pa.Array]:
    """The new columns of ``docs``.  Documents of one shape share a match, which is written once and copied by Arrow."""
    first: dict[int, int] = {}
    rows = [first.setdefault(id(m), i) for i, m in enumerate(found)]
    if 2 * len(first) > len(found):
        return _written(docs, found, with_tiles, with_islands, only)
    kept = list(first.values())
    place = {i: k for k, i in enumerate(kept)}
    once = _written([docs[i] for i in kept], [found[i] for i in kept], with_tiles, with_islands, only)
    at = pa.array([place[i] for i in rows], pa.int64())
    return [x.take(at) for x in once]


def _written(docs: list[bytes], found: list[Match], with_tiles: bool, with_islands: bool, only: Collection[str] | None = None) -> list[pa.Array]:
    made = {
        "n_bytes": lambda: pa.array([len(d) for d in docs], pa.int64()),
        "matched": lambda: pa.array([m.matched for m in found], pa.int64()),
        "complete": lambda: pa.array([m.complete for m in found], pa.bool_()),
        "captures": lambda: _lists([[(*c, depth, parent) for c, (depth, parent) in zip(m.captures, nesting(m.captures), strict=True)] for m in found], _ARROW["captures"]),
        "notes": lambda: _lists([[(x.capture_index, x.pos, x.origin, x.rule_stack, x.label) for x in m.notes] for m in found], _ARROW["notes"]),
        "islands": lambda: _lists([islands(m.captures, m.notes) for m in found], _ARROW["islands"]),
        "tiles": lambda: _lists([tiles(m.captures, len(d)) for m, d in zip(found, docs, strict=True)], _ARROW["tiles"]),
    }
    return [made[name]() for name in _new(with_tiles, with_islands, only)]


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of documents without nulls, and where each begins in them, with their end."""
    _, ends, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    docs = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[docs[0] : docs[-1]], docs - docs[0]


def _valid_parts(column: pa.Array) -> Iterator[tuple[int, int, bool]]:
    """Ranges of documents that are valid UTF-8, and ones of others."""
    data, docs = _laid(column)
    if not len(data) or data.max() < 0x80 or (runs.valid(data.tobytes()) and not ((data[docs[:-1][docs[:-1] < docs[1:]]] & 0xC0) == 0x80).any()):
        yield 0, len(column), True
        return
    good = [runs.valid(data[a:b].tobytes()) for a, b in pairwise(docs.tolist())]
    for own, rows in groupby(range(len(good)), good.__getitem__):
        rows = list(rows)
        yield rows[0], rows[-1] + 1, own


def _of_structs(bounds: np.ndarray, kind: pa.StructType, *columns) -> pa.Array:
    made = [x if isinstance(x, pa.Array) else pa.array(x, kind.field(i).type) for i, x in enumerate(columns)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kind)))


def _stacks(stack: list[str], n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(stack), pa.int32()), pa.array(stack * n, pa.string()))


def _run_columns(plan: runs.Plan, column: pa.Array, with_tiles: bool, with_islands: bool, only: Collection[str] | None = None) -> list[pa.Array]:
    """What ``_columns`` gives for valid documents under a grammar of runs, without a step a character."""
    data, docs = _laid(column)
    found = runs.captures(plan, data, docs)
    kinds = pa.array([x.kind for x in plan.nodes], pa.string())
    depths, told = (np.array([getattr(x, f) for x in plan.nodes], kind) for f, kind in (("depth", np.int32), ("told", bool)))
    sizes = pa.array(np.diff(docs), pa.int64())

    def captures_() -> pa.Array:
        return _of_structs(found.bounds, _ARROW["captures"], kinds.take(pa.array(found.node)), found.start, found.end, depths[found.node], found.parent)

    def notes_() -> pa.Array:
        at = np.flatnonzero(told[found.node])
        bounds = np.searchsorted(at, found.bounds)
        within = at - np.repeat(found.bounds[:-1], np.diff(bounds))
        return _of_structs(bounds, _ARROW["notes"], within, found.start[at], pa.repeat("grammar", len(at)), _stacks(plan.rule_stack or [], len(at)), pa.repeat(pa.scalar(plan.label, pa.string()), len(at)))

    def islands_() -> pa.Array:
        first, last, start, end, bounds = runs.islands(plan, found)
        n = len(first)
        return _of_structs(bounds, _ARROW["islands"], first, last, start, end, _stacks(plan.rule_stack or [], n), pa.repeat(pa.scalar(plan.label, pa.string()), n), np.ones(n, bool))

    def tiles_() -> pa.Array:
        start, end, node, capture, bounds = runs.tiles(plan, found, data, docs)
        return _of_structs(bounds, _ARROW["tiles"], start, end, kinds.take(pa.array(node, mask=node < 0)), capture)

    made = {"n_bytes": lambda: sizes, "matched": lambda: sizes, "complete": lambda: pa.array(np.ones(len(column), bool)), "captures": captures_, "notes": notes_, "islands": islands_, "tiles": tiles_}
    return [made[name]() for name in _new(with_tiles, with_islands, only)]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores in parts of about ``PART_BYTES``, as the optimizer estimates its size.

    A row group is one task, however large it is and however many cores wait.  Rows are dealt by their number, which
    needs no sorting and comes out the same when a task runs again.  What has no estimate stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:
        return df
    least, most = (x * cores for x in PARTS)
    return df.repartition(min(max(least, size // PART_BYTES), most), F.monotonically_increasing_id())


def _matched(narrow: DataFrame, keep: list[str], matcher_of, with_tiles: bool, with_islands: bool, plan_of=lambda: None, only: Collection[str] | None = None) -> DataFrame:
    """``keep`` and the parsed columns of ``narrow`` (keep, _payload, and what ``matcher_of(batch, row)`` looks at).

    ``plan_of()``: how to do without a matcher where documents are valid.
    """
    every = StructType.fromDDL(f"{PARSED}, islands {ISLANDS}, tiles {TILES}")
    new = StructType([every[name] for name in _new(with_tiles, with_islands, only)])
    if clash := set(keep) & set(new.fieldNames()):
        raise ValueError(f"{sorted(clash)} would stand twice")
    schema = StructType([*(StructField(f.name, f.dataType) for f in narrow.schema.fields[: len(keep)]), *new.fields])
    names = schema.fieldNames()

    def run(batches):
        plan = plan_of()
        for batch in batches:
            matcher = matcher_of(batch)
            column = batch.column(len(keep))
            for a, b in _slices(pc.binary_length(column).to_pylist()):
                for c, d, quick in _valid_parts(column.slice(a, b - a)) if plan else ((0, b - a, False),):
                    part = column.slice(a + c, d - c)
                    if quick:
                        made = _run_columns(plan, part, with_tiles, with_islands, only)
                    else:
                        docs = part.to_pylist()
                        made = _columns(docs, [matcher(a + c + i).match(x) for i, x in enumerate(docs)], with_tiles, with_islands, only)
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(a + c, d - c) for i in range(len(keep))] + made, names)

    return spread(narrow).mapInArrow(run, schema)


def _payload(payload: str):
    return F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload")


def parse_documents(df: DataFrame, program: Program, payload: str, keep: list[str], with_tiles: bool = False, with_islands: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df``, then those of ``PARSED``, and ``islands`` and ``tiles`` if asked for.

    ``only``: the new columns that are wanted, if not all.  Spark asks a worker for every column that it declares, so
    that others would be built and moved for nothing.  ``payload`` is a string or binary column.  Kept columns may not have the names of the new ones.
    """
    data = programs.encode(program)

    return _matched(df.select(*keep, _payload(payload)), keep, lambda batch: lambda row: _matcher(data), with_tiles, with_islands, lambda: _plan(data), only)


def parse_by_grammar(df: DataFrame, registry: dict[str, Program], grammar: str, payload: str, keep: list[str], with_tiles: bool = False, with_islands: bool = False) -> DataFrame:
    """Like ``parse_documents``, each row under the program that its column ``grammar`` names.

    All programs travel with the task, encoded; a worker builds the matchers that it meets.  Rows that name no program
    of the registry are left out: ``sources.routing`` names one for every row.
    """
    data = {name: programs.encode(p) for name, p in registry.items()}

    def matcher_of(batch):
        names = batch.column(len(keep) + 1).to_pylist()
        return lambda row: _matcher(data[names[row]])

    narrow = df.where(F.col(grammar).isin(sorted(data))).select(*keep, _payload(payload), F.col(grammar).alias("_grammar"))
    return _matched(narrow, keep, matcher_of, with_tiles, with_islands)


def fold_captures(parsed: DataFrame, keep: list[str], f, returns: str) -> DataFrame:
    """``keep`` and ``roots``: the array of ``f(kind, start, end, values of the children)`` of the outermost captures.

    ``f`` is called bottom-up, children in their order in the document.  Map-only; a document's captures are folded in
    one pass without recursion.
    """
    kept = parsed.select(*keep, "captures")
    schema = StructType([*(StructField(x.name, x.dataType) for x in kept.schema.fields[:-1]), *StructType.fromDDL(f"roots array<{returns}>").fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema.fields[-1].dataType)

    def run(batches):
        for batch in batches:
            roots = []
            for own in batch.column(len(keep)).to_pylist():
                values: list[list] = [[] for _ in own]
                top: list = []
                for i in range(len(own) - 1, -1, -1):  # parents stand before children
                    c = own[i]
                    made = f(c["kind"], c["start"], c["end"], values[i][::-1])
                    values[i] = []
                    (values[c["parent"]] if c["parent"] >= 0 else top).append(made)
                roots.append(top[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(roots, kind)], schema.fieldNames())

    return kept.mapInArrow(run, schema)
