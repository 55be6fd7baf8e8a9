"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .bloom import Bloom
from .common import documents_view, map_arrow, release, scratch, text_steps, written
from .graph import components

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: wh.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their counts.

    Fewer than ``k`` words make one shingle of the whole sequence; no word makes none."""
    grams = wh.kgrams(words.hashes, k)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(np.array([wh.whole(words.hashes[a:b])], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` values for each set (Dahlgaard, Knudsen and Thorup).

    In each of the first ``t`` rounds every element is thrown into a hashed bin, and an empty bin takes the least value
    thrown into it; a bin once filled stays.  Round ``t + b`` throws all elements into bin ``b``, so at the end no bin of a
    non-empty set is empty.  Sets of n elements are done after about max(1, t log t / n) rounds."""
    out = np.full(len(sizes) * t, _TOP, np.uint64)
    empty = np.ones(len(sizes) * t, bool)
    of = np.repeat(np.arange(len(sizes)), sizes)
    u = elements
    steps = np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for r in range(2 * t):
        if not len(u):
            break
        h = wh.mix(u + steps[r])
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if r < t else np.full(len(u), r - t)
        at = of * t + bins
        open_ = empty[at]
        at, values = at[open_], wh.mix(h[open_] ^ np.uint64(0x9FB21C651E98DF25))
        np.minimum.at(out, at, values)
        empty[at] = False
        waiting = empty.reshape(-1, t).any(1)
        if not waiting[of[0]] or not waiting[of].all():
            keep = waiting[of]
            u, of = u[keep], of[keep]
    return out.reshape(-1, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` sketch values; the band's number is part of it."""
    n, t = sketch.shape
    cut = sketch.reshape(n, t // rows, rows)
    h = np.broadcast_to(wh.mix(np.arange(1, t // rows + 1, dtype=np.uint64)), (n, t // rows))
    for i in range(rows):
        h = wh.pair(h, cut[:, :, i])
    return h


def _signatures(batches: Iterator[pa.RecordBatch], k: int, t: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_steps(batches):
        words = wh.Words(data, offsets, wh.BLANKS, lower=True)
        elements, sizes = shingle_sets(words, k)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        halves = []
        for seed in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(elements ^ np.uint64(seed)), dtype=np.uint64)])
            halves.append(wh.signed(wh.mix(sums[starts[1:]] - sums[starts[:-1]])))
        full = sizes > 0
        keys = bands(sketches(elements, sizes[full], t), rows)
        ends = np.concatenate([[0], np.cumsum(full) * (t // rows)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(wh.signed(np.ascontiguousarray(keys).reshape(-1))))
        yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(halves[0]), pa.array(halves[1]), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int, wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Sets of the documents whose ids the filter holds, made where the texts lie."""
    some = (batch.filter(pa.array(wanted.may_hold(batch.column(0)))) for batch in batches)
    for batch, data, offsets in text_steps(some):
        elements, sizes = shingle_sets(wh.Words(data, offsets, wh.BLANKS, lower=True), k)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [elements[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "elements"])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leader and part, the leader's own set first: only that one set is held.

    For each other set: the size of the common part, whether it is enough, and the elements that the leader lacks."""
    leader, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, part, b, blobs = (batch.column(i) for i in range(4))
        out: list[list] = [[], [], [], [], [], []]
        for x, p, y, blob in zip(a.to_pylist(), part.to_pylist(), b.to_pylist(), blobs, strict=True):
            own = np.frombuffer(blob.as_buffer(), np.uint64)
            if y is None:
                leader, held = (x, p), own
            elif leader == (x, p):
                at = np.searchsorted(held, own)
                at[at == len(held)] = 0
                there = held[at] == own
                common = int(there.sum())
                linked = 100 * common >= percent * (len(held) + len(own) - common)
                for column, v in zip(out, (x, y, len(held), common, linked, own[~there].view(np.int64)), strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["a", "b", "n_a", "common", "linked", "added"])


class _Linker:
    """Finds all links among candidates that can matter to the components, without listing the pairs of a bucket.

    In each bucket all members are compared with a leader (the member with the most company).  Let two members x and y share
    no element that the leader lacks.  Then what they have in common lies in the leader, so |x & y| <= min(|x & leader|,
    |y & leader|).  Hence a further link between members of different components needs a common element outside the
    leader, or sizes that this bound allows.  The former are the buckets of the next level, one for each leader and outside
    element, as far as they matter (``_prefixes``); the latter pairs are compared one by one, and so are those of a level
    whose buckets hold few."""

    #: Levels at most; pairs for each member up to which a level's buckets are listed pair by pair instead.
    LEVELS, LISTED = 4, 16

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle: int, percent: int):
        self.docs, self.shingle, self.percent = docs, shingle, percent
        self.facts = classes.where("rep is not null").select("rep", "n")
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None
        self.sets: DataFrame | None = None

    def run(self, keys: DataFrame) -> DataFrame | None:
        for level in range(self.LEVELS):
            members = self._mixed(keys)
            if members is None:
                return self.comp
            if level and members.agg(F.sum(F.col("n") - 1) <= 2 * self.LISTED * F.count("n")).first()[0]:
                break
            if self.sets is None:
                # sets that the filter lets through by chance meet no pair
                wanted = Bloom(members.select("id"))
                self.sets = written(map_arrow(self.docs, partial(_sets, k=self.shingle, wanted=wanted), "id long, elements binary"), "sets")
            company = written(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
            rank = F.struct(F.col("company"), (-F.col("id")).alias("order"))
            leaders = written(members.join(company, "id").groupBy("key").agg(F.max(rank).alias("m")).select("key", (-F.col("m.order")).alias("a")), "leaders")
            pairs = members.join(leaders, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
            compared = written(self._compared(pairs), f"compared{level}")
            self._link(compared.where("linked"))
            mixed = self._labelled(compared.select("a", "b", "n_a", "common", "linked", "added"), "b")
            groups = written(mixed.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("a"), "groups")
            if groups.isEmpty():
                return self.comp
            rest = written(mixed.join(groups, "a", "left_semi"), "rest")
            self._check(self._bounded(rest))
            keys = self._prefixes(rest)
        else:
            members = self._mixed(keys)
        if members is not None:
            one, two = members.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), members.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
            self._check(one.join(two, "key").where("a < b and ca <> cb").select("a", "b"))
        return self.comp

    def _labelled(self, df: DataFrame, column: str) -> DataFrame:
        if self.comp is None:
            return df.withColumn("comp", F.col(column))
        return df.join(self.comp.toDF(column, "component"), column, "left").withColumn("comp", F.coalesce("component", column)).drop("component")

    def _mixed(self, keys: DataFrame) -> DataFrame | None:
        """Members (key, id, comp, n) of buckets that hold more than one component."""
        keys = written(self._labelled(keys, "id"), "keys")
        buckets = written(keys.groupBy("key").agg(F.count("id").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "n"), "buckets")
        members = written(keys.join(buckets, "key"), "members")
        release(keys, buckets)
        return None if members.isEmpty() else members

    def _compared(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        sets = self.sets
        parts = written(pairs.groupBy("a").agg(F.ceil(F.count("b") / 64).cast("int").alias("parts")), "parts")
        heads = parts.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "elements")
        cut = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
        tails = cut.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "elements")
        both = heads.union(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return map_arrow(both, partial(_compare, percent=self.percent), "a long, b long, n_a long, common long, linked boolean, added array<long>")

    def _link(self, linked: DataFrame) -> None:
        linked = linked.select("a", "b")
        self.links = linked if self.links is None else self.links.union(linked)
        if not linked.isEmpty():
            self.comp = written(components(self.links), "components")

    def _check(self, pairs: DataFrame) -> None:
        """Compare pairs that sizes do not rule out."""
        one, two = self.facts.toDF("a", "na"), self.facts.toDF("b", "nb")
        near = pairs.distinct().join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent).select("a", "b")
        self._link(written(self._compared(near).where("linked").select("a", "b"), "links"))

    def _prefixes(self, rest: DataFrame) -> DataFrame:
        """Buckets (key, id) of the next level: leader and outside element.

        x, with c of its n elements in the leader, needs |x & y| >= share * n, so at least q = share * n - c of its outside
        elements are y's as well.  Order outside elements by how many of the leader's members have them, rarest first: then
        x and y share one of the first |outside| - q + 1 of x, and of y.  Elements of one member only fill the first ranks."""
        outside = rest.select("a", "b", F.size("added").alias("size"), (F.ceil((F.col("common") + F.size("added")) * self.percent / 100) - F.col("common")).alias("q"), F.explode("added").alias("e"))
        often = written(outside.groupBy("a", "e").agg(F.count("b").alias("n")).where("n > 1"), "often")
        shared = outside.join(often, ["a", "e"])
        mine = Window.partitionBy("a", "b")
        ranked = shared.withColumn("rank", F.row_number().over(mine.orderBy("n", "e")) + F.col("size") - F.count("e").over(mine))
        return ranked.where(F.col("rank") <= F.col("size") - F.greatest(F.col("q"), F.lit(1)) + 1).select(F.xxhash64("a", "e").alias("key"), F.col("b").alias("id"))

    def _bounded(self, rest: DataFrame) -> DataFrame:
        """Pairs of a leader's members that may link though all they share lies in the leader: min(common) is large enough
        for both sizes.  One of them is not linked with the leader, so the other is smaller than the leader.  They are
        joined on the leader and on classes of size."""
        share = self.percent / 100
        sized = rest.withColumn("n", F.col("common") + F.size("added")).drop("added")
        size_class = lambda c: F.floor(F.log(F.greatest(c, F.lit(1.0))) / F.log(F.lit(1.05))).cast("int")
        x = sized.where("not linked").withColumn("most", F.col("common") * (1 + share) / share - F.col("n")).where(F.col("most") >= F.col("n") * share)
        x = x.select("a", F.col("b").alias("x"), F.col("n").alias("nx"), F.col("common").alias("cx"), F.col("comp").alias("compx"), F.explode(F.sequence(size_class(F.col("n") * share), size_class(F.col("most")))).alias("class"))
        y = sized.where("n < n_a").select("a", F.col("b").alias("y"), F.col("n").alias("ny"), F.col("common").alias("cy"), F.col("comp").alias("compy"), size_class(F.col("n").cast("double")).alias("class"))
        fits = F.least("cx", "cy") * (100 + self.percent) >= (F.col("nx") + F.col("ny")) * self.percent
        both = x.join(y, ["a", "class"]).where(fits & (F.col("compx") != F.col("compy")))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, t: int = 160, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are runs of non-blanks, A-Z lower-cased.  Documents are linked at a Jaccard similarity of shingle sets of at
    least ``percent`` / 100, confirmed on the full sets (64-bit shingle hashes).  A pair at exactly 0.85 shares none of the
    160 / 5 = 32 bands with probability 0.556**32 < 1e-8, one at 0.8 with 0.672**32 < 4e-6; of pairs that share
    one, only those are not compared that cannot link or change no component (see ``_Linker``).

    Equal sets are one class from the start, so copies cost one row each.  A null or empty text has no shingles and links
    with nothing.  Rows of one doc_id are one document.  A row without doc_id takes the smallest id of its class, if any,
    and is never the one kept.  A very long text is one set; an empty table gives an empty result; other columns are not
    read."""
    docs = documents_view(docs)
    with scratch() as keep:
        signs = keep(written(map_arrow(docs, partial(_signatures, k=shingle, t=t, rows=rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "signatures"))
        filled = signs.where("n_shingles > 0")
        classes = written(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
        keys = classes.where("rep is not null").select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
        comp = _Linker(docs, classes, shingle, percent).run(keys)
        if comp is not None:
            named = classes.join(comp.toDF("rep", "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
        else:
            named = classes.select("h1", "h2", F.col("rep").alias("component_id"))
        named = keep(written(named, "named"))
    alone = signs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = filled.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near-duplicates: of each group the document of smallest doc_id
    stays, once, however often it is repeated.  Where rows of one doc_id differ in text, the text of least hash stays.  Rows
    without doc_id cannot be told apart by it and stay.  Cases otherwise as in ``near_duplicates``."""
    names = [f"`{c}`" for c in docs.columns]
    with scratch() as keep:
        groups = near_duplicates(docs, shingle, percent)
        told = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        rest = keep(written(told.where("not kept or rows > 1"), "rest"))
        out_ids = rest.select("doc_id")
        held = Bloom(out_ids).column(F.col("doc_id"))
    # only rows that may be among the rest are moved for the join
    stay = docs.where("doc_id is not null")
    out = stay.where(~held).select(*names).union(stay.where(held).join(out_ids, "doc_id", "left_anti").select(*names))
    often = rest.where("kept").select("doc_id")
    if not often.isEmpty():
        several = docs.join(often, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.xxhash64(F.col("text")).alias("hash"), F.struct(*names).alias("row"))
        least = several.groupBy("id").agg(F.min("hash").alias("hash"))
        out = out.union(several.join(least, ["id", "hash"]).dropDuplicates(["id"]).select("row.*"))
    return out.union(docs.where("doc_id is null").select(*names))
