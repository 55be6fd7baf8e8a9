"""Similarity joins and first-wins near-deduplication."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.work import cut, uncut

#: Items of a block; its most frequent grams of all, which are compared as columns of a matrix; partitions of a side.
BLOCK, COLUMNS, SIDES = 2048, 2048, 16


def gram_set(text: str, n: int = 3) -> set[str]:
    text = text.strip()
    return {text} if len(text) < n else {text[i : i + n] for i in range(len(text) - n + 1)}


def _hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little", signed=True)


def gram_numbers(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted numbers of the distinct grams, none for a blank text: exact up to three characters of 21 bits, hashes beyond."""
    text = (text or "").strip()
    if not text:
        return np.zeros(0, np.int64)
    if n > 3:
        return np.unique(np.array([_hash(g) for g in gram_set(text, n)], np.int64))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    width = min(n, len(codes))
    out = np.zeros(len(codes) - width + 1, np.int64)
    for i in range(width):
        out = out << 21 | codes[i : len(codes) - width + 1 + i]
    return np.unique(out)


def _gram_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, part, distinct grams); a blank text has none."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            out = [gram_numbers(t, n) for t in some.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
            yield pa.record_batch([some.column(0), some.column(1), grams], names=["id", "part", "grams"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each list begins (one entry more)."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()), offsets - offsets[0]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, n = np.unique(_lists(batch.column(0))[0], return_counts=True)
        yield pa.record_batch([pa.array(g), pa.array(n.astype(np.int64))], names=["g", "n"])


def _packed(batches: Iterator[pa.RecordBatch], columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, ph, size, grams) that come sorted: bits of the grams that are columns, and the others as they are."""
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        values, starts = _lists(rows.column(3))
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        there = columns[at] == values
        of = np.repeat(np.arange(rows.num_rows), np.diff(starts))
        bits = np.zeros((rows.num_rows, COLUMNS), bool)
        bits[of[there], at[there]] = True
        rest = np.bincount(of[~there], minlength=rows.num_rows).astype(np.int32)
        ids, ph, size = (np.ascontiguousarray(rows.column(i)) for i in range(3))
        blobs = [x.tobytes() for x in (ids, ph, size.astype(np.int32), rest, np.packbits(bits, axis=1), values[~there])]
        ends = [[v] for v in (int(ph.min()), int(ph.max()), int(size.min()), int(size.max()))]
        return pa.record_batch([*(pa.array(e, pa.int64()) for e in ends), *(pa.array([x], pa.binary()) for x in blobs)], names=["p0", "p1", "s0", "s1", *_BLOBS])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        while sum(x.num_rows for x in held) >= BLOCK:
            rows = pa.Table.from_batches(held)
            yield block(rows.slice(0, BLOCK))
            held = rows.slice(BLOCK).to_batches()
    if sum(x.num_rows for x in held):
        yield block(pa.Table.from_batches(held))


_BLOBS = ["ids", "ph", "sizes", "rest", "bits", "others"]


class _Block:
    def __init__(self, blobs: list[bytes]):
        self.ids, self.ph, self.sizes, self.rest, bits, self.others = (np.frombuffer(x, t) for x, t in zip(blobs, ("i8", "i8", "i4", "i4", "u1", "i8"), strict=True))
        self.bits = np.unpackbits(bits.reshape(len(self.ids), -1), axis=1).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(self.rest)])


def _overlaps(x: _Block, y: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of pairs that reach the threshold, a strip of x at a time.

    The grams in columns are multiplied; those outside add at most the smaller number of them.  Where that can be enough they
    are counted."""
    names, codes = np.unique(np.concatenate([x.others, y.others]), return_inverse=True)
    mine, theirs = codes[: len(x.others)], codes[len(x.others) :]
    mark = np.zeros(len(names), bool)
    for a in range(0, len(x.ids), 512):
        rows = slice(a, a + 512)
        common = x.bits[rows] @ y.bits.T
        total = x.sizes[rows][:, None] + y.sizes[None]
        fits = common + np.minimum(x.rest[rows][:, None], y.rest[None]) >= threshold / (1 + threshold) * total - 1e-3
        fits &= (x.ph[rows][:, None] == y.ph[None]) & (x.ids[rows][:, None] != y.ids[None])
        left, right = [], []
        for i in np.flatnonzero(fits.any(1)).tolist():
            j = np.flatnonzero(fits[i])
            own = mine[x.starts[a + i] : x.starts[a + i + 1]]
            mark[own] = True
            n = y.rest[j].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            run = np.repeat(y.starts[j] - ends[:-1], n) + np.arange(ends[-1])
            seen = np.concatenate([[0], np.cumsum(mark[theirs[run]])])
            mark[own] = False
            both = common[i, j].astype(np.int64) + seen[ends[1:]] - seen[ends[:-1]]
            j = j[both >= threshold * (x.sizes[a + i] + y.sizes[j].astype(np.int64) - both) - 1e-9]
            left.append(np.full(len(j), a + i))
            right.append(j)
        if left:
            yield np.concatenate(left), np.concatenate(right)


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of linked pairs of the blocks in each row, each pair once, the smaller first."""
    for batch in batches:
        for row in batch.to_pylist():
            same = row["a_no"] == row["b_no"]
            x = _Block([row[f"a_{c}"] for c in _BLOBS])
            y = x if same else _Block([row[f"b_{c}"] for c in _BLOBS])
            for i, j in _overlaps(x, y, threshold):
                a, b = x.ids[i], y.ids[j]
                if same:
                    a, b = a[i < j], b[i < j]
                yield np.minimum(a, b), np.maximum(a, b)


def _listed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for a, b in _met(batches, threshold):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _blocks(items: DataFrame, n: int, columns: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Blocks of ``items`` (id, part, text) that are alike in part and size, each a row with a number, and the grams that are
    columns: those given, or the most frequent ones of ``items``."""
    sets = cut(items.select("id", "part", "text").where("id is not null").mapInArrow(partial(_gram_rows, n=n), "id long, part string, grams array<long>").where(F.size("grams") > 0), "grams")
    if columns is None:
        often = sets.select("grams").mapInArrow(_gram_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
        columns = np.array(sorted(r.g for r in often.orderBy(F.desc("n"), "g").limit(COLUMNS).collect()) or [0], np.int64)
    laid = sets.select("id", F.xxhash64("part").alias("ph"), F.size("grams").alias("size"), "grams").where("part is not null")
    laid = laid.repartitionByRange("ph", "size", "id").sortWithinPartitions("ph", "size", "id")
    kinds = "p0 long, p1 long, s0 long, s1 long, " + ", ".join(f"{c} binary" for c in _BLOBS)
    blocks = cut(laid.mapInArrow(partial(_packed, columns=columns), kinds).withColumn("no", F.monotonically_increasing_id()), "blocks")
    uncut(sets)
    return blocks, columns


def _block_pairs(items: DataFrame, threshold: float, n: int) -> DataFrame:
    """Rows of two blocks whose parts and sizes allow links.  Both sides are read where they lie: the product of the two tables
    shuffles each once, whatever the number of pairs."""
    blocks, _ = _blocks(items, n)
    sides = max(1, min(SIDES, blocks.count()))
    x, y = (blocks.repartition(sides).toDF(*(f"{s}_{c}" for c in blocks.columns)) for s in "ab")
    fits = "a_no <= b_no and a_p0 <= b_p1 and b_p0 <= a_p1"
    return x.hint("shuffle_replicate_nl").join(y, F.expr(fits) & (F.col("a_s1") >= F.lit(threshold) * F.col("b_s0") - F.lit(1e-6)) & (F.col("b_s1") >= F.lit(threshold) * F.col("a_s0") - F.lit(1e-6)))


def similar_pairs(items: DataFrame, threshold: float = 0.75, n: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of ``items`` (id, part, text) of one part whose character n-gram sets have a Jaccard similarity of
    at least ``threshold``; with a threshold of 0 or less, that share any gram; above 1, none.

    Every pair of blocks whose sizes allow it is compared on whole sets, so none is missed; only linked pairs leave a task."""
    spark = items.sparkSession
    if threshold > 1:
        return spark.createDataFrame([], "a long, b long")
    if threshold <= 0:
        grams = items.select("id", "part", "text").mapInArrow(partial(_gram_rows, n=n), "id long, part string, grams array<long>")
        g = grams.select("id", "part", F.explode("grams").alias("g"))
        return g.toDF("a", "part", "g").join(g.toDF("b", "part", "g"), ["part", "g"]).where("a < b").select("a", "b").distinct()
    return cut(_block_pairs(items, threshold, n).mapInArrow(partial(_listed, threshold=threshold), "a long, b long"), "similar")


def _like(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            x, y = (_Block([row[f"{s}_{c}"] for c in _BLOBS]) for s in "ab")
            for i, j in _overlaps(x, y, threshold):
                yield pa.record_batch([pa.array(-1 - x.ids[i]), pa.array(y.ids[j])], names=["a", "b"])


class Among:
    """``items`` (id, text), ids not negative, in blocks that are made once; other texts are compared with them, and they are
    never compared with each other."""

    def __init__(self, items: DataFrame, threshold: float, n: int = 3):
        self.items, self.threshold, self.n = items.select("id", F.lit("").alias("part"), "text"), threshold, n
        if 0 < threshold <= 1:
            self.blocks, self.columns = _blocks(self.items, n)
            self.sides = max(1, min(SIDES, self.blocks.count()))

    def like(self, known: DataFrame) -> DataFrame:
        """Pairs (a, b): an id of ``known`` (id, text), ids not negative, and of an item that is similar to it, as in
        ``similar_pairs``."""
        known = known.select((-1 - F.col("id")).alias("id"), F.lit("").alias("part"), "text")
        if not 0 < self.threshold <= 1:
            pairs = similar_pairs(cut(known.union(self.items), "both"), self.threshold, self.n)
            return pairs.where("a < 0 and b >= 0").select((-1 - F.col("a")).alias("a"), "b")
        few, _ = _blocks(known, self.n, self.columns)
        x, y = few.toDF(*(f"a_{c}" for c in few.columns)), self.blocks.repartition(self.sides).toDF(*(f"b_{c}" for c in self.blocks.columns))
        fits = (F.col("a_s1") >= F.lit(self.threshold) * F.col("b_s0") - F.lit(1e-6)) & (F.col("b_s1") >= F.lit(self.threshold) * F.col("a_s0") - F.lit(1e-6))
        n = few.count()
        # one block is handed to all tasks; several are shuffled, each once to every side
        both = y.join(F.broadcast(x), fits) if n <= 1 else x.repartition(min(SIDES, n)).hint("shuffle_replicate_nl").join(y, fits)
        return cut(both.mapInArrow(partial(_like, threshold=self.threshold), "a long, b long"), "like")


def first_wins(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept): walking through ``ids`` (id) in order, an item stays unless an earlier item that stayed is linked to it.

    Rounds decide in parallel what is certain: an undecided item without undecided or kept earlier neighbours stays; one with
    a kept earlier neighbour goes.  Only linked items take part; the result is that of the sequential walk."""
    links, gone = cut(edges.select("a", "b").distinct(), "links"), []
    while not links.isEmpty():
        beatable = links.select(F.col("b").alias("id")).distinct()
        stay = cut(links.select(F.col("a").alias("id")).distinct().join(beatable, "id", "left_anti"), "stay")
        beaten = cut(links.join(stay.toDF("a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "beaten")
        gone.append(beaten)
        # links with what is decided have done their work
        open_ = links.join(stay.toDF("a"), "a", "left_anti").join(beaten.toDF("a"), "a", "left_anti").join(beaten.toDF("b"), "b", "left_anti")
        before, links = links, cut(open_.select("a", "b"), "links")
        uncut(before, stay)
    if not gone:
        return ids.select("id", F.lit(True).alias("kept"))
    lost = cut(reduce(DataFrame.union, gone), "lost").withColumn("kept", F.lit(False))
    return ids.join(lost, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def first_copies(items: DataFrame) -> DataFrame:
    """``items`` (id, text[, part]) without later copies: of equal texts (of one part, trimmed) the least id stays; blank texts
    all stay."""
    part = F.col("part") if "part" in items.columns else F.lit("")
    key = F.when(F.trim("text") != "", F.sha2(F.concat_ws("\u0000", part, F.trim("text")), 256))
    first = items.select("id", key.alias("key")).where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    blank = items.where(F.coalesce(F.trim("text") == "", F.lit(True))).select("id")
    return items.join(first.select("id").union(blank), "id", "left_semi")


def near_dedup(items: DataFrame, threshold: float = 0.75, n: int = 3) -> DataFrame:
    """(id, kept) by ``first_wins`` over ``similar_pairs``; blank texts always stay.

    A copy of an earlier text never stays: either that stays, or what beats it beats the copy.  So only first copies are
    compared, and a group of copies costs no pairs."""
    if threshold > 1:
        return items.select("id", F.lit(True).alias("kept"))
    firsts = cut(first_copies(items.select("id", "part", "text")), "firsts")
    kept = first_wins(firsts.select("id"), similar_pairs(firsts, threshold, n))
    return items.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def near_index(items: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """(id, kept) by ``first_wins`` over ``lsh_pairs`` of first copies."""
    firsts = cut(first_copies(items.select("id", "text")), "firsts")
    kept = first_wins(firsts.select("id"), lsh_pairs(firsts, threshold, n))
    return items.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def is_duplicate(items: DataFrame, seen: DataFrame, threshold: float = 0.75, n: int = 3) -> DataFrame:
    """(id, duplicate): whether an item (id, text) is similar to any of ``seen`` (text), whatever part either is of."""
    known = seen.select("text").distinct().select((-1 - F.monotonically_increasing_id()).alias("id"), F.lit("").alias("part"), "text")
    both = cut(known.union(items.select("id", F.lit("").alias("part"), "text")), "both")
    hit = similar_pairs(both, threshold, n).where("a < 0 and b >= 0").select(F.col("b").alias("id")).distinct().withColumn("duplicate", F.lit(True))
    return items.select("id").join(hit, "id", "left").select("id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


# -- MinHash bands with a given hash family

_MOD = (1 << 32) - 1


@lru_cache(1 << 18)
def _digest(gram: str) -> int:
    return int.from_bytes(hashlib.blake2s(gram.encode(), digest_size=4).digest(), "little")


def minhash_bands(grams: set[str], hashes: int = 32, rows: int = 4) -> list[str]:
    """Bands of minimum hashes h * (2i + 2654435761) + (i + 1) * 2246822519 mod 2**32 over 4-byte BLAKE2s digests."""
    if not grams:
        return []
    values = np.fromiter((_digest(g) for g in grams), np.uint64, len(grams))
    i = np.arange(hashes, dtype=np.uint64)[:, None]
    mixed = values * (i * np.uint64(2) + np.uint64(2654435761)) + (i + np.uint64(1)) * np.uint64(2246822519)
    sign = (mixed & np.uint64(_MOD)).min(1).tolist()  # products wrap at 2**64, which 2**32 divides
    return [f"{b}:" + ",".join(map(str, sign[b * rows : (b + 1) * rows])) for b in range(hashes // rows)]


def _band_rows(batches: Iterator[pa.RecordBatch], n: int, hashes: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [gram_set(t, n) if t and t.strip() else set() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([minhash_bands(g, hashes, rows) for g in grams], pa.list_(pa.string()))], names=["id", "bands"])


def lsh_pairs(items: DataFrame, threshold: float = 0.85, n: int = 3, hashes: int = 32, rows: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of ``items`` (id, text) that share a MinHash band and have a Jaccard similarity of at least
    ``threshold``.

    On text of common grams most bands hold many pairs that are not similar, so similar pairs are found first
    (``similar_pairs``), and their bands are compared."""
    pairs = similar_pairs(items.select("id", F.lit("").alias("part"), "text"), threshold, n)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    signed = items.join(ids, "id", "left_semi").select("id", "text").mapInArrow(partial(_band_rows, n=n, hashes=hashes, rows=rows), "id long, bands array<string>")
    signed = cut(signed.select("id", F.transform("bands", lambda b: F.xxhash64(b)).alias("bands")), "bands")
    both = pairs.join(signed.toDF("a", "x"), "a").join(signed.toDF("b", "y"), "b")
    return both.where(F.arrays_overlap("x", "y")).select("a", "b").distinct()


def linked_items(items: DataFrame, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, class_id, component_id, n_links) for each of ``items`` (id, text): the least id of an equal text (trimmed), the least
    id reachable over links, and how many other items are linked directly, copies among them.

    ``pairs`` links first copies; copies, which are all linked with each other, are counted and never listed.  A blank text is
    linked with nothing."""
    text = F.trim("text")
    key = F.when(text != "", F.sha2(text, 256))
    keyed = items.select("id", key.alias("key"))
    classes = cut(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = cut(items.join(classes.select(F.col("class").alias("id"), "key"), "id").where(key == F.col("key")).select("id", "text").dropDuplicates(["id"]), "firsts")
    links = cut(pairs(firsts), "links")
    both = links.union(links.select("b", "a"))
    size = classes.select(F.col("class").alias("b"), "copies")
    far = both.join(size, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("far"))
    near = components(links).select(F.col("id").alias("class"), "component")
    told = classes.join(far, "class", "left").join(near, "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"))
    out = keyed.join(told, "key", "left")
    return out.select("id", F.coalesce("class", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over ``edges`` (a, b), by contraction to the neighbour of least hash."""
    now, steps = cut(edges.where("a <> b").select("a", "b").distinct(), "edges"), []
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id")))
        step = both.groupBy(F.col("a").alias("id")).agg(best.alias("m"))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
        step = cut(step.select("id", F.least(F.col("m"), own)["id"].alias("to")), "step")
        steps.append(step)
        moved = now.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        now = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    out = steps[-1]
    for step in reversed(steps[:-1]):
        out = step.join(out.toDF("to", "next"), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    out = cut(out, "roots")
    least = out.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component"))
    return out.join(least, "to").select("id", "component")
