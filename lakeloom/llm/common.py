"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``; a folder of our own is used only where that setting
is absent (tests, local shells).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
#: rows of staged tables are wide: so many go to a Python worker at once
ARROW_ROWS = 2500


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    A cluster has to name it: a folder of this machine is made only for a local master.
    """
    for value in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()):
        if value:
            return value.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts lineage: a lost executor costs only the tasks that ran on it,
    never a recomputation of the stages behind the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakeloom-{uuid.uuid4().hex}/{name}"
    rows = spark.conf.get(_ROWS)
    try:
        spark.conf.set(_ROWS, min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS)
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, rows)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (what was made of them is staged)."""
    for table in tables:
        _WRITTEN.remove((table.sparkSession, table.staged_path))
        _delete(table.sparkSession, table.staged_path)
    # shuffle files behind them go once the driver's JVM has noticed that nothing refers to them
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def drop_staged() -> None:
    """Delete the intermediate tables written so far (results read them lazily)."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


atexit.register(drop_staged)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to take blocks of 2 MB and more from the system and to hand them back."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: fixed, it would grow with the blocks that are freed
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library: memory is given back as that one sees fit
        return None
    return libc


@contextlib.contextmanager
def given_back() -> Iterator[None]:
    """What the work inside allocates and frees goes back to the system, not to the allocator's store."""
    libc = _libc()
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow`` in a worker that does not keep memory between tasks.

    Workers are used again by later tasks; what an allocator keeps for itself
    would count against the executor as long as they live.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with given_back():
            yield from work(batches)

    return run


def text_bytes(column: str | Column = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def record_batch(columns: dict[str, object], schema: StructType) -> pa.RecordBatch:
    """A batch of the given columns in the order and types of ``schema``."""
    target = arrow_schema(schema)
    arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else _array(columns[f.name], f.type) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about ``limit`` bytes of ``column``.

    A single longer row still comes whole, alone.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def binary_parts(array: pa.Array):
    """The concatenated bytes of a binary array and its row offsets (numpy views)."""
    import numpy as np

    if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if array.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
