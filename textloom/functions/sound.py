"""Similarity of syllable sequences, and retrieval of names that sound alike."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.edits import distance

GAP, LEAST, TOP = 0.8, 0.52, 5


@lru_cache(1 << 16)
def syllable_cost(a: str, b: str) -> float:
    """0 for the same syllable, else from 0.15 up to 1 by their normalised edit distance."""
    return 0.0 if a == b else min(1.0, 0.15 + 0.85 * distance(a, b) / max(len(a), len(b)))


def sound_similarity(a: Sequence[str], b: Sequence[str]) -> float:
    """1 - alignment cost / longer length, a gap costing 0.8; 0 if either is empty."""
    if not a or not b:
        return 0.0
    row = [j * GAP for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row = row, [i * GAP]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + GAP, row[j - 1] + GAP, before[j - 1] + syllable_cost(x, y)))
    return max(0.0, 1.0 - row[-1] / max(len(a), len(b)))


def similarity(a: Column, b: Column) -> Column:
    @F.udf("double", useArrow=True)
    def alike(x: list, y: list) -> float | None:
        return None if x is None or y is None else sound_similarity(list(x), list(y))

    return alike(a, b)


def retrieve(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """``spans`` (id, sounds) and ``entities`` (name, sounds): the best names for each span, whose lengths differ by two at most
    and that share a syllable, with their margin over the next."""
    words = entities.select("name", F.col("sounds").alias("other"), F.explode(F.array_distinct("sounds")).alias("s"))
    mine = spans.select("id", "sounds", F.explode(F.array_distinct("sounds")).alias("s"))
    met = mine.join(words, "s").where(F.abs(F.size("sounds") - F.size("other")) <= 2).dropDuplicates(["id", "name"])
    scored = met.select("id", "name", similarity(F.col("sounds"), F.col("other")).alias("score")).where(F.col("score") >= LEAST)
    own = Window.partitionBy("id").orderBy(F.desc("score"), "name")
    ranked = scored.withColumn("place", F.row_number().over(own)).withColumn("next", F.lead("score").over(own))
    return ranked.where(F.col("place") <= TOP).select("id", "name", "score", F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)).alias("margin"), "place")
