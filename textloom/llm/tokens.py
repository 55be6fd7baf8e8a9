"""Token ids of documents in wavelet-matrix files, in ascending order of doc_id."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wavelet
from . import wordhash as wh
from .common import documents_view, map_arrow, shared_dir, text_steps

#: Tokens after which a file is closed (a document stays whole), pieces a worker keeps, and bits of a table of slots.
FILE_TOKENS, CACHE, SLOTS = 2_000_000, 1_500_000, 21
#: Bytes of text of a shard, about, and shards whose totals add up in one group.
SHARD_BYTES, GROUP = 12 << 20, 1024


def _classes() -> np.ndarray:
    """0 blanks, 1 letters and all bytes beyond ASCII, 2 digits, 3 the rest of ASCII."""
    out = np.full(256, 3, np.uint8)
    out[[32, 9, 10, 11, 12, 13]] = 0
    out[65:91] = out[97:123] = out[128:] = 1
    out[48:58] = 2
    return out


_CLASS = _classes()
#: Bytes that leave a run between blanks uncut: the apostrophe (contractions) and leads of characters that may not be letters.
_UNCUT = np.zeros(256, bool)
_UNCUT[39] = True
_UNCUT[192:] = True
_UNCUT[195] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces that the tokenizer never merges across, and each document's first piece (one entry more).

    Runs of letters, single digits and runs of marks; a run between blanks that holds an apostrophe or a character outside
    ASCII and the Latin-1 letters is one piece, and the tokenizer cuts it itself."""
    kind = _CLASS[data]
    cuts = offsets[offsets < len(data)]
    odd = _UNCUT[data]
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin a special token
        # the signs for times and division are in the midst of the Latin-1 letters
        odd[:-1] |= (data[:-1] == 195) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    before = np.empty_like(kind)
    before[:1] = 0
    before[1:] = kind[:-1]
    before[cuts] = 0
    begins = (kind != 0) & (before == 0)
    starts = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
    if odd.any():
        run = np.cumsum(begins)  # number of the run between blanks
        uncut = np.zeros(int(run[-1]) + 1, bool)
        uncut[run[odd]] = True
        starts = starts[begins[starts] | ~uncut[run[starts]]]
    # a piece ends where the next one starts, or at a blank or the end of the document before that
    stops = np.flatnonzero(np.concatenate([(kind[1:] == 0) & (kind[:-1] != 0), [True]]) | np.isin(np.arange(1, len(kind) + 1), cuts) & (kind != 0)) + 1
    ends = np.minimum(np.append(starts[1:], len(data)), stops[np.searchsorted(stops, starts, side="right")]) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes steps of text piece by piece, each distinct piece once as long as its ids are kept.

    The tokenizers meant here lower-case, drop white space and never merge across it or between letters, digits and marks, so
    a text's ids are its pieces' ids in order.  Pieces are found by their 64-bit hash in two tables of slots and, where both
    slots are taken, in a sorted rest; no Python object is made for a piece that is known."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = self.tokenizer.to_str()
        self.by_piece = all(x in rules for x in ('"Removed"', "|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", '"Lowercase"', '"NFC"'))
        self.by_piece &= all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)  # where each piece's ids start
        self.ids = np.zeros(0, self.kind)
        self.slots = [np.full(1 << SLOTS, -1, np.int32) for _ in range(2)]
        self.rest_keys, self.rest = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOTS) if table == 0 else keys & np.uint64((1 << SLOTS) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's entry, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        found = self.slots[0][self._slot(keys, 0)]
        wrong = np.flatnonzero((found < 0) | (self.keys[found] != keys))
        second = self.slots[1][self._slot(keys[wrong], 1)]
        second[(second < 0) | (self.keys[second] != keys[wrong])] = -1
        found[wrong] = second
        if len(self.rest) and (lost := wrong[second < 0]).size:
            at = np.minimum(np.searchsorted(self.rest_keys, keys[lost]), len(self.rest) - 1)
            found[lost] = np.where(self.rest_keys[at] == keys[lost], self.rest[at], -1)
        return found

    def _add(self, keys: np.ndarray, strings: list[str]) -> None:
        """Enter distinct new keys with the ids of their strings."""
        encoded = self._encode(strings)
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in encoded])])
        self.ids = np.concatenate([self.ids, *encoded])
        left = np.arange(first, len(self.keys), dtype=np.int32)
        for table, slots in enumerate(self.slots):
            slot = self._slot(self.keys[left], table)
            free = slots[slot] < 0
            slots[slot[free]] = left[free]  # of several for one slot, the last stays
            left = left[slots[slot] != left]
        if len(left):
            rest = np.concatenate([self.rest, left])
            order = np.argsort(self.keys[rest])
            self.rest, self.rest_keys = rest[order], self.keys[rest][order]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        """Strings of letters only are encoded many at a time: each is one word to the tokenizer."""
        out: list[np.ndarray | None] = [None] * len(strings)
        words = [i for i, x in enumerate(strings) if x.isalpha()]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            found = self.tokenizer.encode(" ".join(strings[i] for i in some), add_special_tokens=False)
            ids, of = np.array(found.ids, self.kind), np.array([-1 if x is None else x for x in found.word_ids])
            cuts = np.flatnonzero(np.diff(of)) + 1
            if len(cuts) + 1 == len(some) and (of >= 0).all():
                for i, x in zip(some, np.split(ids, cuts), strict=True):
                    out[i] = x
        return [self._plain(strings[i]) if x is None else x for i, x in enumerate(out)]

    def step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a step, and the number of each."""
        raw = data.tobytes()
        if not self.by_piece:
            each = [self._plain(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(x) for x in each], np.int64)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, first = pieces(data, offsets)
        keys = wh.hash_spans(data, starts, ends, lower=True)
        entry = self._find(keys)
        if (new := np.flatnonzero(entry < 0)).size:
            fresh, where = np.unique(keys[new], return_index=True)
            if len(self.keys) + len(fresh) > CACHE:
                self._forget()
                fresh, where = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            self._add(fresh, [raw[starts[i] : ends[i]].decode() for i in new[where]])
            entry[new] = self._find(keys[new])
        sizes = self.at[entry + 1] - self.at[entry]
        ends_of = np.cumsum(sizes)
        total = int(ends_of[-1]) if len(sizes) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.at[entry] - ends_of + sizes, sizes)]
        bounds = np.concatenate([np.zeros(1, np.int64), ends_of])[first]
        return ids, np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _files(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    partition, segment, ids, counts, parts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def row() -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        content = wavelet.encode(tokens, np.concatenate(counts), ids)
        return pa.record_batch([pa.array([partition], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([content], pa.binary())], names=["shard", "segment", "n_tokens", "content"])

    for batch, data, offsets in text_steps(batches):
        found, n = encoder.step(data, offsets)
        tokens = np.insert(found, np.cumsum(n), np.array(end, encoder.kind))
        ids += batch.column(0).to_pylist()
        counts.append(n + 1)
        parts.append(tokens)
        size += len(tokens)
        if size >= FILE_TOKENS:
            yield row()
            segment, ids, counts, parts, size = segment + 1, [], [], [], 0
    if ids:
        yield row()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, segment, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            file = wavelet.WaveletFile(content.as_buffer().to_pybytes())
            tokens = file.tokens().astype("<u4")
            cuts = file.starts.tolist()
            sums = [zlib.crc32(tokens[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(sums)
            yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(cuts[:-1], pa.int64()), pa.array(file.counts), pa.array(sums, pa.int64())], names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write wavelet-matrix files, in ascending order of (doc_id, text).

    Each row of the Parquet table at ``path`` holds one whole file in ``content``, under (shard, segment) in the order of the
    documents, and goes wherever Spark writes.  A null text counts as empty, and so as the end id alone; rows without doc_id
    come first; repeated rows are written as often as they come; a very long text stays whole in one file; an empty table
    gives no file.  Documents are dealt out by ranges of that order (of texts, by their beginning), about ``shard_bytes`` of
    text each, so that one doc_id may have many texts."""
    docs = documents_view(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    laid = docs.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    map_arrow(laid, partial(_files, path=tokenizer, end=end), "shard int, segment int, n_tokens long, content binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at ``path``.

    Starts add up by groups of ``GROUP`` shards, by shard and within each; only one row for each group meets in one task."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / GROUP).cast("int"))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    groups = totals.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("group_base"))
    bases = totals.select("shard", "group", before(Window.partitionBy("group").orderBy("shard")).alias("shard_base")).join(groups, "group")
    inner = files.select("shard", "segment", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")).alias("inner"))
    starts = inner.join(bases, "shard").select("shard", "segment", (F.col("group_base") + F.col("shard_base") + F.col("inner")).alias("base"))
    decoded = map_arrow(files.select("shard", "segment", "content"), _documents, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/textloom/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end)
    return read_token_files(spark, path)
