"""License scans by diagonal voting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import map_arrow, text_steps, written

# Phrases that name a licence, and notices of public licences with the method's own labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
]
#: Word pairs of two of these cast no vote: they are everywhere and tell nothing.
ORDINARY = frozenset("a and any are in is it of or that the this to under with".split())

#: Diagonals of one template at most so far apart are merged; shares of a notice that must vote, and be confirmed.
SHIFT, VOTES, CONFIRMED = 2, 0.5, 0.8
#: A notice of fewer words must stand whole: four words of five also name another licence.
LONG = 8
K = 2


def _templates() -> list[tuple[list[str], str]]:
    return [(text.split(), label) for text, label in BASE + NOTICES]


def _positions() -> list[tuple[int, int, int]]:
    """(pair hash, template, position) of all voting word pairs: as many as the fixed templates have words."""
    out = []
    for t, (words, _) in enumerate(_templates()):
        grams = wh.kgrams(wh.hash_text(" ".join(words), wh.NOT_ALNUM, lower=True), K)
        out += [(int(g), t, i) for i, g in enumerate(wh.signed(grams)) if t < len(BASE) or not ORDINARY.issuperset(words[i : i + K])]
    return out


def _voters() -> list[int]:
    counts = [0] * len(_templates())
    for _, t, _ in _positions():
        counts[t] += 1
    return counts


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's rolling pair hashes, in order; a pair across two documents is left out."""
    for batch, data, offsets in text_steps(batches):
        words = wh.Words(data, offsets, wh.NOT_ALNUM, lower=True)
        inside = wh.inside_documents(words, K)
        grams = wh.kgrams(words.hashes, K)[inside]
        ends = np.concatenate([[0], np.cumsum(np.maximum(0, words.counts() - K + 1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(wh.signed(np.ascontiguousarray(grams))))
        yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["k1", "k2", "grams"])


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirm the merged spans on the words themselves."""
    templates = [([w.encode() for w in words], label) for words, label in _templates()]
    for batch, data, offsets in text_steps(batches):
        words = wh.Words(data, offsets, wh.NOT_ALNUM, lower=True)
        found = batch.column(2).to_pylist()
        rows: list[list] = [[] for _ in range(7)]
        for d, spans in enumerate(found):
            first, end = int(words.first[d]), int(words.first[d + 1])

            def text(a: int, b: int, first: int = first, end: int = end) -> list[bytes]:
                a, b = max(first, first + a), min(end, first + b)
                return [data[words.starts[i] : words.ends[i]].tobytes().lower() for i in range(a, b)]

            places, base, own, score = [], set(), set(), 0.0
            for span in spans or []:
                want, label = templates[span["template"]]
                if span["template"] < len(BASE):
                    for start in span["full"]:
                        if text(start, start + len(want)) == want:
                            places.append(start)
                            base.add(label)
                            score = 1.0
                else:
                    share = _common(text(span["low"] - SHIFT, span["high"] + len(want) + SHIFT), want) / len(want)
                    if share >= (CONFIRMED if len(want) >= LONG else 1):
                        own.add(label)
                        score = max(score, share)
            for column, value in zip(rows, (end - first, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_spans(docs: DataFrame) -> DataFrame:
    """Merged diagonals: (k1, k2, spans) for every distinct text (named by two hashes) with enough votes.

    All rolling word-pair hashes of all texts are joined to the templates' positions.  A match votes for a diagonal, the
    word where the template would start; a diagonal has at most as many distinct votes as its template has words, so equal
    texts add nothing.  Neighbouring diagonals of a template (words put in or left out) are merged into one span."""
    spark = docs.sparkSession
    # bounded by the fixed templates
    positions = F.broadcast(spark.createDataFrame(_positions(), "gram long, template int, position int"))
    voters = F.broadcast(spark.createDataFrame(list(enumerate(_voters())), "template int, voters int"))
    grams = map_arrow(docs, _grams, "k1 long, k2 long, grams array<long>").select("k1", "k2", F.posexplode("grams").alias("start", "gram"))
    votes = grams.join(positions, "gram").groupBy("k1", "k2", "template", (F.col("start") - F.col("position")).alias("diagonal")).agg(F.collect_set("position").alias("at"))
    line = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > SHIFT
    merged = votes.withColumn("run", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(line)).join(voters, "template")
    spans = merged.groupBy("k1", "k2", "template", "run").agg(
        F.min("diagonal").alias("low"),
        F.max("diagonal").alias("high"),
        F.array_sort(F.collect_list(F.when((F.size("at") == F.col("voters")) & (F.col("template") < len(BASE)), F.col("diagonal")))).alias("full"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"),
        F.first("voters").alias("voters"),
    )
    enough = spans.where(F.when(F.col("template") < len(BASE), F.size("full") > 0).otherwise(F.col("n") >= F.col("voters") * VOTES))
    return enough.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("template", "low", "high", "full"))).alias("spans"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased; a word is a run of ASCII letters, digits and non-ASCII characters.  Base places are those where a
    phrase's words stand one after the other.  ``labels`` adds the notices of which at least 0.8 of the words (all, of fewer
    than eight) stand in a merged span in order; ``score`` is 1 for a base place, else the largest such share, else 0.  A null text counts as empty:
    no words, no labels, score 0.  Repeated rows get equal results; nothing depends on doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("k1", F.xxhash64(F.lit(1), "text")).withColumn("k2", F.xxhash64(F.lit(2), "text"))
    spans = written(license_spans(keyed.select("k1", "k2", "text")), "spans")
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return map_arrow(joined, _judged, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
