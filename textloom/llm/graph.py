"""Connected components as DataFrames: nothing is gathered on the driver or in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Forest:
    """Union-find over arbitrary integers; a tree's root is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while p.get(x, x) != root:
            p[x], x = root, p[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent.setdefault(a, a)
        self.parent[b] = a
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.parent if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 500_000:  # bounded memory: what is known so far goes on as edges
            yield _pairs(*forest.edges())
            forest = Forest()
    yield _pairs(*forest.edges())


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a graph of at most ``LAST`` edges, and the smallest that it is connected with."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    nodes = list(forest.parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["node", "to"])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as (node, neighbour) both ways."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        yield _pairs(np.concatenate([a, b]), np.concatenate([b, a]))


#: Edges up to which one task finishes what is left.
LAST = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b, long) -> (node, component): the smallest node reachable; nodes without an edge are absent.

    Each partition's edges are first reduced to a spanning forest.  Then, round by round, every node points to its
    neighbour of least hash (random contraction), the graph is contracted along these pointers, and the number of nodes
    shrinks by a constant factor, whatever the diameter; the last ``LAST`` edges are settled in one task.  Pointers are
    followed back at the end.  Tables of a round are written to the shared folder."""
    now = written(edges.where("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        if now.limit(LAST + 1).count() <= LAST:
            steps.append(written(now.coalesce(1).mapInArrow(_settled, "node long, to long"), "pointers"))
            break
        both = now.union(now.select("b", "a"))
        # the least (hash, id) among a node and its neighbours
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        step = written(least.select("node", F.least(F.col("m"), own)["id"].alias("to")), "pointers")
        steps.append(step)
        a, b = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        moved = now.join(a, "a").join(b, "b").where("to_a <> to_b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        now = written(moved.mapInArrow(_forest, "a long, b long"), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = steps[-1]
    for step in reversed(steps[:-1]):
        # a node's target may have no pointer of its own in the next round: then it is a root already
        nxt = out.toDF("to", "next")
        out = step.join(nxt, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    out = written(out, "roots")
    # written, so that the join below has an exchange on either side and a giant component's rows can be split
    names = written(out.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component")), "names")
    return out.join(names, "to").select("node", "component")
