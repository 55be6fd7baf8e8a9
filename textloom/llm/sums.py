"""Sums of equally long arrays over all tasks, added up block by block and never as rows of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Numbers in a block.
BLOCK = 1 << 15


def blocks(key: int, array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array's blocks that hold anything, as rows (key, block, body)."""
    flat = array.reshape(-1)
    for i in range(0, len(flat), BLOCK):
        part = flat[i : i + BLOCK]
        if part.any():
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([i // BLOCK], pa.int32()), pa.array([part.tobytes()])], names=["key", "block", "body"])


def _added(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, block): one block is held."""
    at, held = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([held.tobytes()])], names=["key", "block", "body"])

    for batch in batches:
        for key, block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            part = np.frombuffer(body.as_buffer(), kind)
            if at == (key, block):
                held += part
            else:
                if at is not None:
                    yield row()
                at, held = (key, block), part.copy()
    if at is not None:
        yield row()


def added(rows: DataFrame, shapes: dict[int, tuple[int, ...]], kind: str = "f8") -> dict[int, np.ndarray]:
    """Add up ``rows`` (key, block, body) by key.  To the driver come as many numbers as ``shapes`` hold, whatever the rows."""
    sums = map_arrow(rows.repartition("key", "block").sortWithinPartitions("key", "block"), lambda b: _added(b, kind), "key long, block int, body binary")
    out = {k: np.zeros(int(np.prod(s)), kind) for k, s in shapes.items()}
    for r in sums.toLocalIterator():
        part = np.frombuffer(r.body, kind)
        out[r.key][r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return {k: out[k].reshape(s) for k, s in shapes.items()}
