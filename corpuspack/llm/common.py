"""What several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words and that exact copies may differ in.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Workers flush their output at about this many bytes.
FLUSH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def kept_in_worker(name: str, make: Callable):
    """What ``make`` gives, kept in this worker for later tasks that ask for the same name. Functions come to a worker
    anew with each task; what is to outlive them is put on a module of the interpreter's own. A worker keeps
    one thing at a time: another name, or forget_in_worker, lets go of it."""
    held = getattr(sys, "_corpuspack_kept", None)
    if held is None or held[0] != name:
        forget_in_worker()
        held = sys._corpuspack_kept = name, make()
    return held[1]


def forget_in_worker() -> None:
    """Also gives memory that earlier tasks of this worker no longer use back to the system."""
    sys._corpuspack_kept = None
    gc.collect()
    pa.default_memory_pool().release_unused()
    # glibc keeps what lies below memory still in use; elsewhere there is no such call
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a bounded slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def batches_of(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (row, bytes) pairs, cut where enough bytes have gathered."""
    held: list[tuple] = []
    weight = 0
    for row, size in rows:
        held.append(row)
        weight += size + 16
        if weight >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=f.type) for values, f in zip(zip(*rows), schema)], schema=schema
    )
