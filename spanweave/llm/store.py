"""Shared working tables and Arrow batch helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a Python worker; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of rows that an executor and its Python worker hand each other at once, and rows that Spark decodes at once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCHES in this session from now on, except where it has settings of its own.

    A batch lies in the executor's buffers, which grow by doubling, and in the worker's; by default it has 64 MiB.  A
    longer row is a batch of its own.  Rows and their order don't depend on it.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def workdir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new local one where that is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanweave-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{workdir(spark).rstrip('/')}/spanweave/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table that ``saved`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spanweave/" in name:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(name)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


_HELD: dict = {}


def held_once(key, build: Callable):
    """``build()``, kept in this worker process until another key is asked for: one model, matcher or encoder at a time."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Hand memory that nothing uses any more back to the system; workers outlive the operator that grew them."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` (no nulls) of about ``limit`` bytes each, never splitting a text."""
    sizes = pc.binary_length(texts).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def filled(column: pa.Array) -> pa.Array:
    """Texts with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def map_slices(df: DataFrame, text: str, work: Callable, schema: str) -> DataFrame:
    """``work(batch, texts) -> RecordBatch`` over slices of every partition, through Arrow.

    ``texts`` is the column ``text`` of the slice as a large string array without nulls.
    """

    def run(batches):
        for batch in batches:
            texts = filled(batch.column(text))
            for a, b in text_slices(texts):
                yield work(batch.slice(a, b - a), texts.slice(a, b - a))

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, text: str, work: Callable, fields: str) -> DataFrame:
    """``df`` with further columns that ``work(texts) -> list of arrays`` makes from the whole texts of column ``text``.

    Map-only: rows stay where they are and keep their other columns.  An input column that has the name of a new one
    is replaced.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in set(new.fieldNames())]
    names = [f.name for f in kept] + new.fieldNames()
    position = df.columns.index(text)
    places = [df.columns.index(f.name) for f in kept]

    def run(batches):
        for batch in batches:
            texts = filled(batch.column(position))
            for a, b in text_slices(texts):
                made = work(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in places] + made, names)

    return df.mapInArrow(run, StructType([*kept, *new.fields]))
