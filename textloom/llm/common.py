"""Shared plumbing of the operators: work tables, Arrow scans and table paths."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at a time; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Share of the driver's largest heap from which on it is cleared after a work table is written.
HEAP = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only where it is unset and Spark runs in one process, as in
    tests, a temporary folder is set; a cluster without it has no such folder, and then this fails."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Work tables of the scopes that are open, the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Work tables written inside are removed at the end, but for those given to the function that this yields."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scopes.remove(mine)
        if _scopes:
            _scopes[-1].extend(kept)
        release(*(df for df in mine if all(df is not k for k in kept)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files outlive a lost executor.  They are removed when the scope ends (``scratch``), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    _relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def _relieve(spark: SparkSession) -> None:
    """The driver's heap holds hardly more than what finished steps have left there; it is given back before it grows to its
    bound."""
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() * HEAP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Remove work tables that nothing reads any more, and let the driver drop the shuffle files of finished steps."""
    spark = SparkSession.active()
    for df in tables:
        _remove(spark, df._written_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a work table; at exit the session may be gone already, and then the folder's owner cleans up."""
    if spark.sparkContext._jsc is None or spark.sparkContext._gateway is None:
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM has ended before us
        pass


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into steps of about ``step`` bytes of text: (rows, their bytes, offsets of rows in the bytes).

    A null text counts as empty.  ``lower``: letters of all alphabets are lower-cased."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if lower:
            texts = pc.utf8_lower(texts)
        offsets, data = text_buffers(texts)
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array, without a Python object per row; nulls have length 0."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of a bounded number of rows and bytes, so a worker's memory does not follow the texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = df.sparkSession.conf.get(key).rstrip("b")
        if not (now.isdigit() and int(now) <= most):
            df.sparkSession.conf.set(key, str(most))
    return df.mapInArrow(partial(_tidy, function=function), schema)


def _tidy(batches: Iterator[pa.RecordBatch], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """A worker outlives its task and is one of several: what the task has freed goes back to the system at its end."""
    try:
        yield from function(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def _libc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_trim = _libc_trim()


def documents_view(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read; extra columns, whatever their names, stay outside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
