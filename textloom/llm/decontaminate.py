"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from . import wordhash as wh
from .common import documents_view, map_arrow, scratch, text_steps, written

#: Bytes of text taken at a time: a word becomes a row of up to ITEMS numbers here.
STEP = 1 << 17
#: Benchmark items in one scan (more are taken in blocks), items whose words are counted at a time, words of half a passage.
ITEMS, CHUNK, HALF = 20_000, 224, 32
#: The TF-IDF matrix: bits of a column's number (words are hashed to columns), and singular directions kept.
SLOT_BITS, RANK = 14, 48
#: Tasks at most that fit the space on all documents; each sends one sum of 4 MB, so their disk does not grow.
FIT_TASKS = 32
#: Half passages that make a task of its own worth while, and that are multiplied at a time.
TASK_HALVES, GROUP = 1000, 1024
#: A column that a group has more often is multiplied as a dense row.
DENSE = 48
#: A word in more than this share of half passages is no term.
COMMON = 0.05
#: Share of an item's words that must stand in order: alone, or with this share of its answer words present, or with these in a
#: passage very near to the item in the latent space.
COPY, PARAPHRASE, LOOSE, ANSWERS, ANSWER_WORDS = 0.7, 0.5, 0.35, 0.8, 5
#: Latent cosine of a candidate, and of a passage that says the same in other words.
CANDIDATE, ALIKE = 0.2, 0.7


class Items:
    """A block of benchmark items: word hashes, and the terms among them in a table of slots."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        self.words = [wh.hash_text(t, wh.NOT_ALNUM, lower=True) for t in pc.utf8_lower(pa.array([t for _, t in rows], pa.string())).to_pylist()]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.shift = np.uint64(64 - max(8, int(len(self.terms)).bit_length() + 6))
        self.slots = np.full(1 << int(64 - self.shift), -1, np.int32)
        order = np.argsort(self.terms >> self.shift, kind="stable")
        slot = (self.terms[order] >> self.shift).astype(np.int64)
        self.slots[slot] = order  # terms of one slot: the last; the others are looked up
        self.shared = np.zeros(len(self.slots), bool)
        self.shared[slot[1:][slot[1:] == slot[:-1]]] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int32)
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & (self.terms[out] != hashes))
        out[wrong] = -1
        lost = wrong[self.shared[slot[wrong]]]
        if lost.size:
            at = np.minimum(np.searchsorted(self.terms, hashes[lost]), len(self.terms) - 1)
            out[lost] = np.where(self.terms[at] == hashes[lost], at, -1)
        return out


def _halves(words: wh.Words) -> tuple[np.ndarray, np.ndarray]:
    """The half passage of every word, numbered over the step, and each document's first (one entry more)."""
    counts = words.counts()
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(-(-counts // HALF))])
    doc = words.document_of()
    return first[doc] + (np.arange(len(doc)) - words.first[doc]) // HALF, first


def _slots(hashes: np.ndarray) -> np.ndarray:
    """The column of the TF-IDF matrix that each word has."""
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


#: Keys of the rows that one scan for frequencies makes: sums, and the columns of each half passage's words.
_HALVES, _TERMS, _SLOTS, _WORDS = range(4)


def _packed(slots: np.ndarray, half: np.ndarray, n: int) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in (slots.astype(np.uint16), np.bincount(half, minlength=n).astype(np.uint8))]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each step's words, two bytes each, and how many of them each half passage has."""
    for _, data, offsets in text_steps(batches, step=STEP, lower=True):
        words = wh.Words(data, offsets, wh.NOT_ALNUM, lower=True)
        half, first = _halves(words)
        yield pa.record_batch(_packed(_slots(words.hashes), half, int(first[-1])), names=["body", "sizes"])


def _frequencies(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """A task's number of half passages, and of those that hold each term and each column's words; and for each step what
    ``_columns`` tells."""
    totals = {_HALVES: np.zeros(1), _TERMS: np.zeros(len(items.terms) + 1), _SLOTS: np.zeros(1 << SLOT_BITS)}
    for _, data, offsets in text_steps(batches, step=STEP, lower=True):
        words = wh.Words(data, offsets, wh.NOT_ALNUM, lower=True)
        half, first = _halves(words)
        totals[_HALVES] += int(first[-1])
        term, slot = items.find(words.hashes), _slots(words.hashes)
        there = np.flatnonzero(term >= 0)
        for key, of, column in ((_TERMS, half[there], term[there]), (_SLOTS, half, slot)):
            width = len(totals[key])
            both = of * width + column
            both = np.sort(both.astype(np.int32) if int(first[-1]) * width < 1 << 31 else both)
            totals[key] += np.bincount(both[np.r_[True, both[1:] != both[:-1]][: len(both)]] % width, minlength=width)
        body, sizes = _packed(slot, half, int(first[-1]))
        yield pa.record_batch([pa.array([_WORDS], pa.int64()), pa.array([0], pa.int32()), body, sizes], names=["key", "block", "body", "sizes"])
    for key, total in totals.items():
        for rows in sums.blocks(key, total):
            yield rows.append_column("sizes", pa.nulls(1, pa.binary()))


# -- the latent space


def _multiplied(slots: np.ndarray, sizes: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Add C'C x to ``out``, where C counts the words of each column (``slots``) in each half passage (``sizes`` words)."""
    first = np.cumsum(sizes) - sizes
    rows = np.zeros((len(sizes), x.shape[1]), np.float32)
    for j in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > j)
        rows[at] += x[slots[first[at] + j]]
    half = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(slots, kind="stable")
    slots, half = slots[order], half[order]
    cuts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    count = np.diff(np.append(cuts, len(slots)))
    often = np.repeat(count > DENSE, count)
    if often.any():
        names, row = np.unique(slots[often], return_inverse=True)
        dense = np.bincount(row * len(sizes) + half[often], minlength=len(names) * len(sizes)).reshape(len(names), -1)
        out[names] += dense.astype(np.float32) @ rows
    # the others: each column's first word, then the second ones, so that no column comes twice at a time
    cuts, count = cuts[count <= DENSE], count[count <= DENSE]
    for j in range(int(count.max(initial=0))):
        at = cuts[count > j] + j
        out[slots[at]] += rows[half[at]]


def _range(batches: Iterator[pa.RecordBatch], idf: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's part of A'A x, where A has a row for each half passage and a column for each slot."""
    out = np.zeros(x.shape, np.float32)
    weighed, there = x * idf[:, None], idf > 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settled() -> None:
        _multiplied(*(np.concatenate(c) for c in zip(*held, strict=True)), weighed, out)
        held.clear()

    for batch in batches:
        for body, sizes in zip(batch.column(0), batch.column(1), strict=True):
            slots, sizes = np.frombuffer(body.as_buffer(), np.uint16), np.frombuffer(sizes.as_buffer(), np.uint8).astype(np.int64)
            used = there[slots]
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(used)])
            ends = np.cumsum(sizes)
            held.append((slots[used], before[ends] - before[ends - sizes]))
            if sum(len(n) for _, n in held) >= GROUP:
                settled()
    if held:
        settled()
    yield from sums.blocks(0, out * idf[:, None])


def latent_words(docs: DataFrame, idf: np.ndarray, halves: float) -> np.ndarray:
    """Each column's coordinates in the latent space: a text's are the sum of its words'.

    A randomised singular value decomposition (Halko, Martinsson and Tropp): A'A times ``RANK`` + 16 random directions spans
    nearly what the leading right singular vectors span; within that basis they and the singular values are exact.  Texts are
    folded in, each coordinate divided by its singular value.  The space is fitted on the half passages of all documents:
    ``docs`` (text), or (body, sizes) as ``_columns`` tells them."""
    if "text" in docs.columns:
        docs = map_arrow(docs.select(F.col("text").cast("string").alias("text")), _columns, "body binary, sizes binary")
    whole = docs.select("body", "sizes").coalesce(max(1, min(FIT_TASKS, int(halves // TASK_HALVES))))

    def squared(x: np.ndarray) -> np.ndarray:
        rows = map_arrow(whole, partial(_range, idf=idf.astype(np.float32), x=x.astype(np.float32)), "key long, block int, body binary")
        return sums.added(rows, {0: x.shape}, "f4")[0].astype(np.float64)

    basis, _ = np.linalg.qr(squared(np.random.default_rng(20240607).normal(size=(len(idf), RANK + 16))))
    inner = basis.T @ squared(basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    kept = np.flatnonzero(values > max(values[-1], 0.0) * 1e-6)[::-1][:RANK]
    if not len(kept):
        return np.zeros((len(idf), 1), np.float32)
    return np.ascontiguousarray((basis @ vectors[:, kept]) * idf[:, None] / np.sqrt(values[kept]), np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a column of the table as one integer's bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Telling:
    """The telling words of all items, and the latent space: what a worker needs to search."""

    def __init__(self, items: Items, idf: np.ndarray, words: np.ndarray):
        self.items, self.idf, self.words = items, idf, words
        # telling words by term; an item with fewer than four of them is judged on all its words
        self.core, self.held, self.answers, self.plain = [], [], [], []
        for w in items.words:
            term = items.find(w)
            telling = term[idf[term] > 0] if len(w) else term
            self.plain.append(len(telling) < 4)
            core = (term if self.plain[-1] else telling).tolist()
            self.core.append(core)
            self.held.append(frozenset(core))
            rare = sorted({(-float(idf[t]), t) for t in core})[:ANSWER_WORDS]
            self.answers.append({t for _, t in rare})
        self.latent = np.array([words[_slots(w)].sum(0) for w in items.words], np.float32).reshape(len(items.words), words.shape[1])
        #: how many of an item's telling words must stand in a stretch for ``judge`` to accept it: without the answer, and with
        #: that many of its words
        self.need, self.loose = (np.array([np.ceil(share * len(core)) if core else 1 << 30 for core in self.core], np.int32) for share in (PARAPHRASE, LOOSE))
        self.answered = np.array([max(1, np.ceil(ANSWERS * len(a))) for a in self.answers], np.int32)
        self.chunks = [np.arange(a, min(a + CHUNK, len(self.core))) for a in range(0, len(self.core), CHUNK)]

    def counts(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a term counts for an item; the terms that are in some item's answer, and whether in this item's."""
        out = np.zeros((len(self.items.terms), len(chunk)), np.uint8)
        for i, item in enumerate(chunk):
            out[self.core[item], i] = 1
        terms = np.array(sorted(set().union(*(self.answers[item] for item in chunk))), np.int64)
        answers = np.zeros((len(terms), len(chunk)), np.int32)
        for i, item in enumerate(chunk):
            answers[np.searchsorted(terms, sorted(self.answers[item])), i] = 1
        return out, terms, answers

    def cosine(self, item: int, slots: np.ndarray) -> float:
        """The largest cosine of an item and a window of its length in a stretch of words, in the latent space."""
        size = max(1, len(self.items.words[item]))
        step = max(1, size // 4)
        ends = np.cumsum(np.r_[np.zeros((1, self.words.shape[1]), np.float32), self.words[slots]], axis=0, dtype=np.float64)
        at = np.arange(0, max(1, len(slots) - size + step), step)
        windows = ends[np.minimum(at + size, len(slots))] - ends[at]
        own = self.latent[item].astype(np.float64)
        lengths = np.sqrt((windows * windows).sum(1) * (own @ own))
        return float(np.max(windows @ own / np.where(lengths > 0, lengths, np.inf), initial=0.0))

    def judge(self, item: int, region: list[int], slots: np.ndarray) -> tuple[bool, float]:
        """Whether a stretch (of terms, and of columns) holds an item, and the share of the item's telling words found in
        order."""
        core, held = self.core[item], self.held[item]
        both = [x for x in region if x in held]
        if not core or len(both) < LOOSE * len(core):
            return False, 0.0
        found = held.intersection(both)
        answered = len(self.answers[item] & found) >= ANSWERS * len(self.answers[item])
        # no more can stand in order than stand there at all
        if min(len(both), sum(x in found for x in core)) < (LOOSE if answered else COPY) * len(core):
            return False, 0.0
        share = common_subsequence(core, both) / len(core)
        # a candidate by its cosine is judged by words; both must hold, so the cheaper one is asked first
        if share < (LOOSE if answered else COPY):
            return False, share
        near = self.cosine(item, slots)
        return near >= CANDIDATE and (share >= (PARAPHRASE if answered else COPY) or near >= ALIKE), share


def _found(batches: Iterator[pa.RecordBatch], telling: Telling) -> Iterator[tuple[pa.RecordBatch, list[dict[int, float]]]]:
    """Steps of rows, and for each row the items found and their shares."""
    items = telling.items
    longest = max((len(w) for w in items.words), default=0)
    spare = -(-longest // HALF)
    tables = [telling.counts(chunk) for chunk in telling.chunks] if len(telling.chunks) <= 4 else None
    for batch, data, offsets in text_steps(batches, step=STEP, lower=True):
        words = wh.Words(data, offsets, wh.NOT_ALNUM, lower=True)
        n = batch.num_rows
        found: list[dict[int, float]] = [{} for _ in range(n)]
        half, first = _halves(words)
        term = items.find(words.hashes)
        known = np.flatnonzero(term >= 0)
        there = known[telling.idf[term[known]] > 0]
        used = known if any(telling.plain) else there
        if not used.size:
            yield batch, found
            continue
        slots, known_terms, there_terms = _slots(words.hashes), term[known], term[there]
        h = half[used]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        doc = np.repeat(np.arange(n), np.diff(first))
        # a passage is two neighbouring halves, or a document's only one; a wider stretch never holds fewer words of an item
        begin = np.flatnonzero((np.arange(len(doc)) < first[doc + 1] - 1) | (first[doc + 1] - first[doc] == 1))
        begin_doc = doc[begin]
        low, high = np.maximum(first[begin_doc], begin - spare), np.minimum(first[begin_doc + 1], begin + 2 + spare)
        close = np.minimum(first[begin_doc + 1], begin + 1 + spare)  # what the longest item may take from here on
        for c, chunk in enumerate(telling.chunks):
            table, rare, answers = tables[c] if tables else telling.counts(chunk)
            held = np.zeros((int(first[-1]) + 1, len(chunk)), np.int32)
            # a half has at most HALF words, so a byte holds its counts
            held[h[starts] + 1] = np.add.reduceat(table[term[used]], starts, axis=0, dtype=np.uint8)
            np.cumsum(held, axis=0, out=held)
            place = np.searchsorted(rare, term[used]) if len(rare) else np.zeros(len(used), np.int64)
            told = np.flatnonzero(rare[np.minimum(place, len(rare) - 1)] == term[used]) if len(rare) else np.zeros(0, np.int64)
            answered = np.zeros(held.shape, np.int32)
            np.add.at(answered, h[told] + 1, answers[place[told]])
            np.cumsum(answered, axis=0, out=answered)
            for a in range(0, len(begin), 4096):
                rows = slice(a, a + 4096)
                hit = held[high[rows]] - held[low[rows]] >= telling.need[chunk]
                # fewer words, but the answer among them and all close together
                near = np.argwhere(answered[close[rows]] - answered[begin[rows]] >= telling.answered[chunk])
                if len(near):
                    i, j = near.T
                    enough = held[close[rows][i], j] - held[begin[rows][i], j] >= telling.loose[chunk][j]
                    hit[i[enough], j[enough]] = True
                done: dict[int, tuple[int, int, int]] = {}
                for i, at_ in np.argwhere(hit).tolist():
                    item, d = int(chunk[at_]), int(begin_doc[a + i])
                    at = int(words.first[d]) + (int(begin[a + i]) - int(first[d])) * HALF
                    left, right = max(int(words.first[d]), at - longest), min(int(words.first[d + 1]), at + 2 * HALF + longest)
                    seen, terms = (known, known_terms) if telling.plain[item] else (there, there_terms)
                    x, y = np.searchsorted(seen, (left, right))
                    if done.get(item) == (d, x, y):
                        continue
                    done[item] = (d, x, y)
                    yes, share = telling.judge(item, terms[x:y].tolist(), slots[left:right])
                    if yes and share > found[d].get(item, 0.0):
                        found[d][item] = share
        yield batch, found


def _searched(batches: Iterator[pa.RecordBatch], telling: Telling) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, telling):
        ids = [sorted(telling.items.ids[i] for i in f if telling.items.ids[i] is not None) for f in found]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], names=["doc_id", "key", "n_items", "items", "share"])


def _weights(df: np.ndarray, n: float) -> np.ndarray:
    """Inverse frequencies; words that are common, in a table that is not tiny, have none."""
    return np.where(df > max(COMMON * n, 20), 0.0, np.log((n + 1) / (df + 1)) + 1.0)


def telling_words(docs: DataFrame, rows: list[tuple[int | None, str]]) -> Telling:
    """Weigh the words of items, and the columns of the TF-IDF matrix, by the half passages of all documents that hold them,
    and fit the latent space.  To the driver come one number for each term and each column, and ``RANK`` + 16 for a column."""
    items = Items(rows)
    text = docs.select(F.col("text").cast("string").alias("text"))
    shapes = {_HALVES: (1,), _TERMS: (len(items.terms) + 1,), _SLOTS: (1 << SLOT_BITS,)}
    with scratch():
        scan = written(map_arrow(text, partial(_frequencies, items=items), "key long, block int, body binary, sizes binary"), "halves")
        counts = sums.added(scan.where(F.col("key") != _WORDS).select("key", "block", "body"), shapes)
        n = max(1.0, float(counts[_HALVES][0]))
        seen = np.where(counts[_SLOTS] > 0, _weights(counts[_SLOTS], n), 0.0)
        return Telling(items, _weights(counts[_TERMS][:-1], n), latent_words(scan.where(F.col("key") == _WORDS), seen, n))


def _clean(batches: Iterator[pa.RecordBatch], telling: Telling) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, telling):
        yield batch.filter(pa.array([not f for f in found], pa.bool_()))


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    blocks = max(1, -(-wanted.count() // ITEMS))
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about ITEMS rows
        yield sorted({(r.item_id, r.text) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def reject_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item of ``benchmark`` is found; cases as in
    ``contamination``."""
    out, schema = docs, docs.schema
    for rows in _item_blocks(benchmark):
        out = map_arrow(out, partial(_clean, telling=telling_words(docs, rows)), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, share) for every row of ``docs`` (doc_id, text), against all of ``benchmark``
    (item_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.  Telling words stand in at most a
    twentieth of all half passages (32 words).  Passages of 64 words at steps of 32, or a shorter document's only one, with the
    longest item's length to spare on both sides, are looked at for every item of whose telling words they hold half, or 0.35
    and the answer within that length, and are candidates if a window of the item's length has a cosine of 0.2 or more with it in the latent space (``latent_words``).
    An item is found if at least 0.7 of its telling words (all words, if fewer than four tell) stand there in order; or 0.5,
    and at least 0.8 of its five rarest words, the answer, are present; or 0.35 with the answer and a latent cosine of 0.7, a
    paraphrase.  ``items`` lists the found items' ids in order, ``share`` is the largest share.  Null and empty texts, and items
    without words, are never found.  Repeated rows get equal results, rows without doc_id their own; a very long text is searched
    passage by passage; an empty table gives none; other columns are not read.

    The documents are read twice, once for counts and once for the search, whatever the number of items (up to ``ITEMS``), and
    no text is moved.  The first scan writes two bytes for each word, which the fit of the space reads twice."""
    docs = documents_view(docs)
    blocks = list(_item_blocks(benchmark))
    keyed = docs.withColumn("key", F.monotonically_increasing_id()) if len(blocks) > 1 else docs.withColumn("key", F.lit(0).cast("long"))
    schema = "doc_id long, key long, n_items long, items array<long>, share double"
    out = None
    for rows in blocks:
        found = map_arrow(keyed.select("doc_id", "key", "text"), partial(_searched, telling=telling_words(docs, rows)), schema)
        out = found if out is None else out.union(found)
    if len(blocks) > 1:
        out = out.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_items").alias("n_items"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("share").alias("share"))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "items", "share")
