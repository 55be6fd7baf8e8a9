"""Bloom filters of ids, of one size whatever the table: rows that a join would drop are told where they lie and not moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import map_arrow

#: Blocks of a filter and bits of each, as powers of two (4 MB in all); places of an id, which lie in one block.
BLOCKS, BITS, PLACES = 4, 21, 4
#: Tasks that fill a filter.
TASKS = 8


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's block, and its places in there, a row for each id."""
    h = wh.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E6C63D0876A9A35))
    step = wh.mix(h) | np.uint64(1)
    at = h[:, None] + step[:, None] * np.arange(PLACES, dtype=np.uint64)
    return (wh.mix(h ^ step) >> np.uint64(64 - BLOCKS)).astype(np.int64), (at & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).drop_null()
        yield pa.record_batch([pa.array(_places(np.asarray(ids))[0]), ids], names=["block", "id"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks: dict[int, np.ndarray] = {}
    for batch in batches:
        block, at = _places(np.asarray(batch.column(1)))
        for b in np.unique(block).tolist():
            marks.setdefault(b, np.zeros(1 << BITS, bool))[at[block == b]] = True
    for b, bits in marks.items():
        yield pa.record_batch([pa.array([b], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])


class Bloom:
    """Holds every id it was made of, and by chance few others: about one in 500 of them at 2 million ids."""

    def __init__(self, ids: DataFrame):
        """Of ``ids`` (one column, long; nulls do not count).  To the driver comes the filter alone."""
        rows = map_arrow(ids, _numbered, "block long, id long").repartition("block").coalesce(TASKS)
        self.bits = np.zeros((1 << BLOCKS, 1 << BITS - 3), np.uint8)
        for r in map_arrow(rows, _filled, "block long, bits binary").collect():  # a row for each block, one job
            self.bits[r.block] |= np.frombuffer(r.bits, np.uint8)

    def may_hold(self, ids: pa.Array) -> np.ndarray:
        block, at = _places(np.asarray(ids.fill_null(0)))
        there = (self.bits[block[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(1)
        return there & np.asarray(ids.is_valid())

    def column(self, id_: Column) -> Column:
        """``may_hold`` of a column of ids."""
        held = self.may_hold

        def told(ids: pa.Array) -> pa.Array:
            return pa.array(held(ids))

        return F.arrow_udf(told, "boolean")(id_.cast("long"))
