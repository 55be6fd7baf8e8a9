"""Substring dedup: recurring 20-word passages, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import map_arrow, release, scratch, text_steps, written

#: Words of a window's anchor; passages in an automaton; documents that one copy of an automaton serves.
ANCHOR, SHARD, SERVED = 8, 20_000, 2_000


def _anchors(words: wh.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchor-length word runs, and for every window start the start of its anchor: the run of least hash
    inside the window.  Equal windows have equal anchors, and neighbouring windows mostly share one."""
    anchor = min(ANCHOR, window)
    grams = wh.kgrams(words.hashes, anchor)
    span = window - anchor + 1
    n = len(words.hashes) - window + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    # hash above, place below: the least of a window tells where it stands, and the first of equals wins
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least, size = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[:n], least[span - size : span - size + n])
    return grams, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _emit_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each document's windows: (k1, anchor, whether it stands there twice)."""
    for batch, data, offsets in text_steps(batches):
        words = wh.Words(data, offsets, wh.BLANKS, lower=False)
        grams, at = _anchors(words, window)
        at = np.unique(at[wh.inside_documents(words, window)])
        doc = words.document_of()[at]
        order = np.lexsort((grams[at], doc))
        g, d = grams[at][order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(g))) > 1
        keys = np.asarray(batch.column(0))
        yield pa.record_batch([pa.array(keys[d[first]]), pa.array(wh.signed(g[first])), pa.array(twice)], names=["k1", "anchor", "twice"])


def _fresh(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Drop rows whose key is that of the row before: copies that a join has brought together.  One that is missed costs
    time and changes nothing."""
    last = None
    for batch in batches:
        keys = batch.column(column).to_pylist()
        keep = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
        last = keys[-1] if keys else last
        yield batch.take(pa.array(keep, pa.int32())) if len(keep) < len(keys) else batch


def _emit_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor recurs: (window hash, k1, doc_id, first start in the document, whether it stands there twice)."""
    for batch, data, offsets in text_steps(_fresh(batches)):
        words = wh.Words(data, offsets, wh.BLANKS, lower=False)
        grams, at = _anchors(words, window)
        inside = wh.inside_documents(words, window)
        all_ = wh.kgrams(words.hashes, window)
        keys, ids, lists = np.asarray(batch.column(0)), batch.column(1), batch.column(3)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for d in range(batch.num_rows):
            a, b = int(words.first[d]), int(words.first[d + 1]) - window + 1
            if b <= a:
                continue
            hot = np.isin(grams[at[a:b]], lists[d].values.to_numpy().view(np.uint64))
            starts = np.flatnonzero(hot & inside[a:b])
            h, first, n = np.unique(all_[a:b][starts], return_index=True, return_counts=True)
            for column, x in zip(out, (h, np.full(len(h), d), starts[first], n > 1), strict=True):
                column.append(x)
        if out[0]:
            h, d, s, twice = (np.concatenate(x) for x in out)
            yield pa.record_batch([pa.array(wh.signed(h)), pa.array(keys[d]), ids.take(pa.array(d)), pa.array(s.astype(np.int32)), pa.array(twice)], names=["h", "k1", "doc_id", "start", "twice"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document that owns or holds passages, one row as owner for each copy of its automaton, and one as text to
    search for each automaton that may find something in it."""
    for batch in _fresh(batches):
        out: list[list] = [[], [], [], [], [], []]
        for k1, text, shard, parts, starts, routes in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if starts:
                for part in range(parts):
                    for column, x in zip(out, (shard, part, False, k1, text, starts), strict=True):
                        column.append(x)
            for route in routes or []:
                for column, x in zip(out, (route["shard"], route["part"], True, k1, text, None), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        for i in range(0, len(out[0]), 256):
            yield pa.record_batch([pa.array(c[i : i + 256], k) for c, k in zip(out, kinds, strict=True)], names=["shard", "part", "tail", "k1", "text", "starts"])


def _runs(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Stretches of words whose windows all start in ``starts``."""
    order = np.sort(np.array(starts))
    cuts = np.flatnonzero(np.diff(order) != 1) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(order, cuts)]


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (shard, part), owners first: their passages make the automaton, then texts stream through it.

    Words are numbered by the automaton's own dictionary, so a find is an equality of words, not of hashes.  Every find but
    the passage's own first place is a repeat; its words are covered."""
    at, numbers, machine, places, closed = None, {}, None, [], False
    for batch in batches:
        shard, part, tail, k1, text, starts = (batch.column(i).to_pylist() for i in range(6))
        keys, covered = [], []
        for i in range(batch.num_rows):
            if at != (shard[i], part[i]):
                at, numbers, places, closed = (shard[i], part[i]), {}, [], False
                machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            words = text[i].encode().split()
            if not tail[i]:
                for a, b in _runs(starts[i], window):
                    ids = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words[a:b]])
                    for s in range(b - a - window + 1):
                        machine.add_word(ids[s : s + window], len(places))
                        places.append((k1[i], a + s))
                continue
            if not closed:
                machine.make_automaton()
                closed = True
            if not places:
                continue
            key, ranges, last = k1[i], [], -1
            for end, place in machine.iter(tuple(map(numbers.get, words, repeat(0)))):
                a = end - window + 1
                if a == places[place][1] and key == places[place][0]:
                    continue
                if a <= last:
                    last = ranges[-1] = end + 1
                else:
                    last = end + 1
                    ranges += [a, last]
            if ranges:
                keys.append(k1[i])
                covered.append(ranges)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(covered, pa.list_(pa.int32()))], names=["k1", "ranges"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What is left of each row's text."""
    for batch in batches:
        rows: list[list] = [[], [], []]
        for text, copy, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if copy and n >= window:
                words = []
            elif found:
                keep = np.ones(n, bool)
                for ranges in found:
                    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                        keep[a:b] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            for column, x in zip(rows, (n, n - len(words), b" ".join(words)), strict=True):
                column.append(x)
        yield pa.record_batch([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows[2]], pa.string()), pa.array([x.decode() for x in rows[2]], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _repeats(rows: DataFrame, full: DataFrame, window: int) -> DataFrame:
    """(k1, rep, found) for every text: its first document, and the stretches of words that go."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"))
    classes = written(rows.groupBy("k1").agg(F.min(order).alias("rep")), "classes")

    anchors = written(map_arrow(full.select("k1", "text"), partial(_emit_anchors, window=window), "k1 long, anchor long, twice boolean"), "anchors")
    recurring = written(anchors.groupBy("anchor").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("twice").alias("twice")).where("low <> high or twice").select("anchor"), "recurring")
    marks = written(anchors.join(recurring, "anchor", "left_semi").select("k1", "anchor").distinct().groupBy("k1").agg(F.collect_list("anchor").alias("anchors")), "marks")
    release(anchors, recurring)

    # of a text's copies only its first document is read on; the others part from it by their doc_id
    first = lambda plan: plan.join(classes, "k1").withColumn("first", F.col("rep.doc_id")).drop("rep").withColumnRenamed("k1", "key")
    joined = lambda plan: full.select("k1", "doc_id", "text").join(plan, (F.col("k1") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first")))
    marked = joined(written(first(marks), "marked")).select("k1", "doc_id", "text", "anchors")
    windows = written(map_arrow(marked, partial(_emit_windows, window=window), "h long, k1 long, doc_id long, start int, twice boolean"), "windows")
    release(marks)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("k1").alias("k1"), F.col("start").alias("start"))
    counted = windows.groupBy("h").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("twice").alias("twice"), F.min(place).alias("first"))
    firsts = written(counted.where("low <> high or twice").select("h", F.col("first.k1").alias("owner"), F.col("first.start").alias("start")), "firsts")
    shards = max(1, -(-firsts.count() // SHARD))
    shard = F.pmod(F.xxhash64("owner", F.lit(1)), F.lit(shards))
    # a document is searched for its owners' passages, unless all that it holds of them are their first places
    routes = written(windows.join(firsts.select("h", "owner"), "h").where("k1 <> owner or twice").select("k1", shard.alias("shard")).distinct(), "routes")
    release(windows)
    parts = written(routes.groupBy("shard").agg(F.ceil(F.count("k1") / SERVED).cast("int").alias("parts")), "parts")
    owned = firsts.groupBy("owner").agg(F.collect_list("start").alias("starts")).withColumn("shard", shard).join(parts, "shard").select(F.col("owner").alias("k1"), "shard", "parts", "starts")
    dealt = routes.join(parts, "shard").select("k1", F.struct("shard", F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int").alias("part")).alias("route")).groupBy("k1").agg(F.collect_list("route").alias("routes"))
    plan = written(first(owned.join(dealt, "k1", "full")), "plan")
    release(firsts, routes)

    texts = joined(plan).select("k1", "text", "shard", "parts", "starts", "routes")
    streams = map_arrow(texts, _deal, "shard long, part int, tail boolean, k1 long, text string, starts array<int>")
    streams = streams.repartition("shard", "part").sortWithinPartitions("shard", "part", "tail")
    found = written(map_arrow(streams, partial(_search, window=window), "k1 long, ranges array<int>"), "ranges")
    release(plan, parts)
    return written(classes.join(found.distinct().groupBy("k1").agg(F.collect_list("ranges").alias("found")), "k1", "left"), "known")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` consecutive words that covers it also starts earlier, in a document of smaller
    doc_id or earlier in the same one; kept words are joined by one blank.  Words are runs of non-blanks, unchanged.  A null
    text has no words.  An empty table gives none; a very long text is searched as one.  Rows without doc_id come after all others.  Rows equal in doc_id and text are one document; rows of
    one doc_id and different texts are ordered by a hash of the text.

    Texts go by a 64-bit hash; of copies, all but the one of smallest doc_id go at once.  Anchors (one in about seven words)
    that two texts share select the windows worth counting; windows are counted by hash, and each recurring one belongs to
    its first place.  Owners are dealt into shards, whose automata hold their windows word by word, and every document that
    shares a window is searched by its owners' automata; where many documents share, the automaton is copied.  Hashes only
    choose candidates: the automata compare words.  Nothing is gathered by passage, so a passage in a third of all documents
    is one row with a count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k1", F.xxhash64("text"))
    full = rows.where(F.length("text") >= 2 * window - 1)
    with scratch() as keep:
        known = keep(_repeats(rows, full, window))
    # a row that is not its text's first document is a copy
    final = rows.join(known, "k1").select("doc_id", "text", (~F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))).alias("copy"), "found")
    return map_arrow(final, partial(_cut, window=window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
