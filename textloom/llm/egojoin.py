"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sums
from .common import map_arrow, scratch, written
from .graph import components

#: Rows and bytes of a block at most, rows of a leaf of the recursion, leading dimensions of the grid and of bounding boxes.
BLOCK, BYTES, LEAF, GRID, BOX = 32_768, 16 << 20, 512, 8, 16
#: Children of a node in the tree of sequence intervals; blocks compared with one block in one go.
FAN, PART = 16, 4
#: Cosines this near to the threshold are decided by the plain formula on the vectors as they were given.
CLOSE = 1e-9


def _given(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each embedding in double precision, scaled by a power of two (which keeps every digit), or None if it can link with
    nothing."""
    values = column.values
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    nulls = np.asarray(values.is_null())
    offsets = column.offsets.to_numpy()
    for i, there in enumerate(np.asarray(column.is_valid())):
        a, b = offsets[i], offsets[i + 1]
        v = numbers[a:b]
        if not there or a == b or nulls[a:b].any() or not np.isfinite(v).all() or not (most := np.abs(v).max()) > 0:
            yield None
        else:
            yield np.ldexp(v, -int(np.frexp(most)[1])) + 0.0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        if pa.types.is_large_list(column.type):
            column = column.cast(pa.list_(column.type.value_type))
        h1, h2, dims, blobs = [], [], [], []
        for v in _given(column):
            if v is None:
                for x in (h1, h2, dims, blobs):
                    x.append(None)
            else:
                blob = v.tobytes()
                d = hashlib.blake2b(blob, digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                dims.append(len(v))
                blobs.append(blob)
        yield pa.record_batch([ids, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "h1", "h2", "dim", "vec"])


def _matrix(blobs: pa.Array, dim: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in blobs]).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _moments(batches: Iterator[pa.RecordBatch], dims: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums and sums of products of a task's unit vectors."""
    total = {d: np.zeros((d + 1, d)) for d in dims}
    for batch in batches:
        of = np.asarray(batch.column(0))
        for d in dims:
            if (own := np.flatnonzero(of == d)).size:
                m = _unit(_matrix(batch.column(1).take(pa.array(own)), d))
                total[d][0] += m.sum(0)
                total[d][1:] += m.T @ m
    for d, s in total.items():
        yield from sums.blocks(d, s)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal directions, at most ``BOX``, of all vectors of each of the (up to eight most common) lengths.

    What reaches the driver is the d * d moments of these lengths, whatever the number of vectors; a length above 1024 keeps
    its plain axes, which prune as correctly and less."""
    common = classes.groupBy("dim").agg(F.count("rep").alias("n")).orderBy(F.desc("n"), "dim").limit(8).collect()
    counts = {r.dim: r.n for r in common if r.dim <= 1024}
    if not counts:
        return {}
    rows = map_arrow(classes.select("dim", "vec"), partial(_moments, dims=sorted(counts)), "key long, block int, body binary")
    axes = {}
    for d, s in sums.added(rows, {d: (d + 1, d) for d in counts}).items():
        _, v = np.linalg.eigh(s[1:] / counts[d] - np.outer(s[0], s[0]) / counts[d] ** 2)
        axes[d] = np.ascontiguousarray(v[:, ::-1][:, :BOX])
    return axes


def _leading(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates of unit vectors, and last the length of what lies outside them: no two vectors are nearer to each
    other than these rows are."""
    d = unit.shape[1]
    lead = unit @ axes[d] if d in axes else unit[:, :BOX]
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1)))
    return np.c_[lead, np.zeros((len(unit), BOX - lead.shape[1])), rest]


def _cells(lead: np.ndarray, eps: float) -> np.ndarray:
    """Grid order: cells of width eps on the leading axes, then ever finer ones on the same axes and on those that follow."""
    p = min(GRID, lead.shape[1])
    cells = [np.floor(lead[:, :p] / eps), np.floor(lead[:, :p] * 4 / eps), np.floor(lead[:, p:] * 2 / eps)]
    return np.clip(np.concatenate(cells, 1) + 128, 0, 255).astype(np.uint8)


def _placed(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(batch.column(1))
        order: list[bytes | None] = [None] * batch.num_rows
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            for i, row in zip(own, _cells(_leading(_unit(_matrix(batch.column(3).take(pa.array(own)), int(d))), axes), eps), strict=True):
                order[i] = row.tobytes()
        yield pa.record_batch([*batch.columns, pa.array(order, pa.binary())], names=["rep", "dim", "mult", "vec", "cell"])


def _blocks(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in grid order become blocks, each an interval of that order, with its bounding box; a task's blocks are numbered
    behind those of the tasks before it."""
    at, n, held, size = None, TaskContext.get().partitionId() << 24, [], 0

    def row() -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lead = _leading(_unit(_matrix(part.column(3), at)), axes)
        ids, mults = (np.asarray(part.column(i)).astype(np.int64).tobytes() for i in (0, 2))
        vecs = b"".join(x.as_buffer() for x in part.column(3))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([x], k) for x, k in zip((at, n, lead.min(0), lead.max(0), ids, mults, vecs), kinds, strict=True)], names=["dim", "block", "lo", "hi", "ids", "mults", "vecs"])

    for batch in batches:
        dims = np.asarray(batch.column(1))
        a = 0
        while a < batch.num_rows:
            dim = int(dims[a])
            most = max(1, min(rows, BYTES // (8 * dim)))
            if held and (dim != at or size >= most):
                yield row()
                n, held, size = n + 1, [], 0
            at = dim
            b = min(a + int(np.argmax(np.r_[dims[a:] != dim, True])), a + most - size)
            held.append(batch.slice(a, b - a))
            a, size = b, size + b - a
    if held:
        yield row()


class _Block:
    def __init__(self, dim: int, ids: pa.Scalar, mults: pa.Scalar, vecs: pa.Scalar, axes: dict[int, np.ndarray]):
        self.x = np.frombuffer(vecs.as_buffer(), np.float64).reshape(-1, dim)
        self.ids, self.mults = (np.frombuffer(v.as_buffer(), np.int64) for v in (ids, mults))
        self.squares = (self.x * self.x).sum(1)
        self.unit = self.x / np.sqrt(self.squares)[:, None]
        self.lead = _leading(self.unit, axes)
        self.links = np.zeros(len(self.x), np.int64)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            part = self.lead[a:b]
            self.boxes[a, b] = part.min(0), part.max(0)
        return self.boxes[a, b]


def _near(one: _Block, two: _Block, a: int, b: int, c: int, d: int, cosine: float) -> np.ndarray:
    """Which pairs of two intervals link."""
    dots = one.unit[a:b] @ two.unit[c:d].T
    near = dots >= cosine
    i, j = np.nonzero(np.abs(dots - cosine) < CLOSE)
    if len(i):
        plain = (one.x[a + i] * two.x[c + j]).sum(1) / np.sqrt(one.squares[a + i] * two.squares[c + j])
        near[i, j] = plain >= cosine
    return near


def _join(one: _Block, two: _Block, cosine: float, eps: float, edges: tuple[list[int], list[int]]) -> None:
    """Recursive join of two sequences; intervals whose boxes are farther apart than eps hold no pair."""
    same = one is two
    todo = [(0, len(one.ids), 0, len(two.ids))]
    while todo:
        a, b, c, d = todo.pop()
        (lo1, hi1), (lo2, hi2) = one.box(a, b), two.box(c, d)
        gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
        if gap @ gap > eps * eps + 1e-6:
            continue
        if max(b - a, d - c) > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                halves = [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                halves = [(a, b, c, m), (a, b, m, d)]
            todo += [h for h in halves if not same or h[3] > h[0]]  # in one block, only pairs i < j
            continue
        near = _near(one, two, a, b, c, d, cosine)
        if same:
            near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not near.any():
            continue
        one.links[a:b] += near @ two.mults[c:d]
        two.links[c:d] += near.T @ one.mults[a:b]
        _span(near, one.ids[a:b], two.ids[c:d], edges)


def _span(near: np.ndarray, left: np.ndarray, right: np.ndarray, edges: tuple[list[int], list[int]]) -> None:
    """Edges that connect what ``near`` connects: all of a few links, else a star for each component."""
    if np.count_nonzero(near) <= 2 * sum(near.shape):
        i, j = np.nonzero(near)
        edges[0].extend(left[i].tolist())
        edges[1].extend(right[j].tolist())
        return
    rows = near.any(1)
    while rows.any():
        first = int(np.flatnonzero(rows)[0])
        r = np.zeros(len(left), bool)
        r[first] = True
        while True:
            c = near[r].any(0)
            grown = near[:, c].any(1)
            if (grown == r).all():
                break
            r = grown
        root = int(left[first])
        others = left[r].tolist() + right[c].tolist()
        edges[0].extend([root] * len(others))
        edges[1].extend(others)
        rows &= ~r


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head block, share), the head first: one block is held, joined with itself if told so, and the others
    pass by."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    held, at = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            key, role = tuple(row.column(k)[0].as_py() for k in range(3)), row.column(3)[0].as_py()
            block = _Block(key[0], *(row.column(k)[0] for k in (4, 5, 6)), axes)
            edges: tuple[list[int], list[int]] = ([], [])
            if role < 2:  # 0: a head; 1: a head that is joined with itself as well
                held, at = block, key
                if not role:
                    continue
            elif at != key:
                raise ValueError("a block came before its head")
            held.links[:] = 0
            _join(held, block, cosine, eps, edges)
            parts = [held] if block is held else [held, block]
            ids = np.concatenate([x.ids[x.links > 0] for x in parts])
            links = np.concatenate([x.links[x.links > 0] for x in parts])
            kinds = np.concatenate([np.zeros(len(ids), np.int8), np.ones(len(edges[0]), np.int8)])
            yield pa.record_batch([pa.array(kinds), pa.array(np.concatenate([ids, np.array(edges[0], np.int64)])), pa.array(np.concatenate([links, np.array(edges[1], np.int64)]))], names=["kind", "x", "y"])


def _apart(eps: float) -> Column:
    """Whether the boxes of two intervals are provably farther apart than eps."""
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > F.lit(eps * eps + 1e-6)


def interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """``boxes`` (dim, block, lo, hi), blocks numbered in grid order -> (dim, a, b), a <= b: pairs of blocks that may hold a
    link.

    The sequence is a tree of intervals, ``FAN`` children to a node; the join descends it level by level from the root joined
    with itself, and drops pairs of intervals whose boxes are farther apart than eps."""
    bound = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(BOX + 1)]).alias(c)
    level = boxes.select("dim", F.col("block").alias("node"), "lo", "hi")
    tree = [level]
    up = F.shiftright("node", 24)  # first all blocks of a task, then ever more tasks
    while tree[-1].groupBy("dim").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").limit(1).count():
        tree[-1] = tree[-1].withColumn("parent", up)
        tree.append(written(tree[-1].groupBy("dim", F.col("parent").alias("node")).agg(bound(F.min, "lo"), bound(F.max, "hi")), "intervals"))
        up = F.floor(F.col("node") / FAN).cast("long")
    pairs = tree[-1].select("dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(tree[:-1]):
        one = level.select("dim", F.col("parent").alias("a"), F.col("node").alias("x"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        two = level.select("dim", F.col("parent").alias("b"), F.col("node").alias("y"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        pairs = pairs.join(one, ["dim", "a"]).join(two, ["dim", "b"]).where((F.col("x") <= F.col("y")) & ~_apart(eps)).select("dim", F.col("x").alias("a"), F.col("y").alias("b"))
        pairs = written(pairs, "interval_pairs")
    return pairs


def embedding_links(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding); other columns are not read.

    Vectors link at a cosine of at least ``cosine``, in double precision; within 1e-9 of it the plain formula on the vectors as
    given decides.  A vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do
    vectors of different length; a row without vec_id links with nothing and has no component.  Each row is a vector: repeated
    rows, or rows of one vec_id, are links of each other and count as such, and rows of one vec_id have one component.  An empty
    table gives an empty result.  Vectors that differ by a power of two at most are one class with a multiplicity from the
    start, so a third of all rows being one vector costs one row.

    Unit vectors are sorted by grid cells of width eps = sqrt(2 - 2 cosine) on the leading principal axes, a cell's own by finer
    cells on these and further axes, and cut into intervals of that order (at most ``block`` vectors).  Pairs of intervals are
    joined recursively, from the whole sequence down to blocks in tables, from blocks to leaves in tasks; pairs whose bounding
    boxes on 16 axes and the length of the rest are farther apart than eps are skipped.  A pair of blocks yields link counts
    and a spanning forest, never its list of links."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    with scratch() as keep:
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        vecs = keep(written(map_arrow(rows, _read, "vec_id long, h1 long, h2 long, dim int, vec binary"), "vectors"))
        usable = vecs.where("vec_id is not null and dim is not null")
        classes = written(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("mult"), F.min("dim").alias("dim"), F.min("vec").alias("vec")), "classes")
        classes = classes.withColumn("node", F.xxhash64("h1", "h2"))
        axes = principal_axes(classes)
        placed = map_arrow(classes.select(F.col("node").alias("rep"), "dim", "mult", "vec"), partial(_placed, axes=axes, eps=eps), "rep long, dim int, mult long, vec binary, cell binary")
        wide = classes.agg(F.sum(F.length("vec")).alias("bytes"), F.count("rep").alias("n")).first()
        tasks = max(1, -(-(wide.n or 0) // block), -(-(wide.bytes or 0) // BYTES))
        laid = placed.repartitionByRange(tasks, "dim", "cell", "rep").sortWithinPartitions("dim", "cell", "rep")
        blocks = written(map_arrow(laid, partial(_blocks, axes=axes, rows=block), "dim int, block long, lo array<double>, hi array<double>, ids binary, mults binary, vecs binary"), "blocks")
        pairs = interval_pairs(blocks.select("dim", "block", "lo", "hi"), eps)
        met = pairs.select("dim", "a", "b", F.floor(F.shiftright("b", 24) / PART).alias("share"))
        bodies = ["ids", "mults", "vecs"]
        tails = met.where("a <> b").join(blocks.select("dim", F.col("block").alias("b"), *bodies), ["dim", "b"]).select("dim", "a", "share", F.lit(2).alias("role"), *bodies)
        shares = met.groupBy("dim", "a", "share").agg(F.max((F.col("a") == F.col("b")).cast("int")).alias("role"))
        heads = shares.join(blocks.select("dim", F.col("block").alias("a"), *bodies), ["dim", "a"]).select("dim", "a", "share", "role", *bodies)
        both = heads.union(tails).repartition("dim", "a", "share").sortWithinPartitions("dim", "a", "share", "role")
        found = written(map_arrow(both, partial(_compare, cosine=cosine, axes=axes), "kind byte, x long, y long"), "found")
        links = found.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
        # classes that share a vec_id hang together as well
        twice = usable.groupBy("vec_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("vec_id")
        own = usable.join(twice, "vec_id", "left_semi").select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        names = classes.select("node", "rep")
        edges = found.where("kind = 1").join(names.toDF("x", "a"), "x").join(names.toDF("y", "b"), "y").select("a", "b").union(own.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
        comp = components(edges)
        known = classes.select("h1", "h2", "node", "rep", "mult").join(links, "node", "left").join(comp.toDF("rep", "component"), "rep", "left")
        known = keep(written(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known"))
    out = usable.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vecs.where("vec_id is null or dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
