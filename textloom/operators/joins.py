"""Joins with their contracts: unique keys, exact id sets, ordered folds, glossary places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.evaluate import unique_or_raise

#: Glossary rows up to which it is broadcast.
BROADCAST = 100_000
#: First words of a glossary up to which texts are searched for them in place.
FEW = 256


def match_records(asr: DataFrame, rubric: DataFrame, key: str, output: str) -> DataFrame:
    """Inner join on a key that must be unique on both sides; a missing output is the empty text, not a missing row."""
    left, right = unique_or_raise(rubric, key), unique_or_raise(asr, key)
    return left.join(right, key).withColumn(output, F.coalesce(output, F.lit("")))


def exact_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: empty if the sets are equal."""
    one, two = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return one.join(two, key, "full").where("in_a is null or in_b is null").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def with_aliases(entities: DataFrame, aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """Entities with their aliases folded into one sorted list."""
    folded = aliases.groupBy(key).agg(F.array_sort(F.collect_set(alias)).alias("aliases"))
    return entities.join(folded, key, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def conflicts(rows: DataFrame, source: Column, target: str) -> DataFrame:
    """Sources with more than one target."""
    return rows.groupBy(source.alias("source_key")).agg(F.count_distinct(target).alias("targets"), F.count(F.lit(1)).alias("n")).where("targets > 1")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def glossary_places(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``texts`` (id, text) and ``glossary`` (surface): (id, surface, n) for surfaces whose words (runs of ASCII letters and
    digits) stand in the text one after the other.

    Runs of the surfaces' lengths are joined by equality; with few first words only runs that begin with one are made."""
    known = glossary.select("surface", _words("surface").alias("g")).where(F.size("g") > 0)
    known = known.select("surface", F.array_join("g", " ").alias("key"), F.size("g").alias("k"), F.col("g")[0].alias("first"))
    lengths = sorted(r.k for r in known.select("k").distinct().collect())  # one number for each length that a surface has
    firsts = [r.first for r in known.select("first").distinct().limit(FEW + 1).collect()]
    at = F.sequence(F.lit(1), F.size("w"))
    if len(firsts) <= FEW:
        begins = F.array(*map(F.lit, firsts)) if firsts else F.array().cast("array<string>")
        at = F.filter(at, lambda i: F.array_contains(begins, F.element_at("w", i)))
    runs = texts.select("id", _words("text").alias("w")).where(F.size("w") > 0).select("id", "w", at.alias("at"))
    grams = lambda k: F.transform(F.filter("at", lambda i: i + (k - 1) <= F.size("w")), lambda i: F.array_join(F.slice("w", i, k), " "))
    each = runs.select("id", F.explode(F.concat(*map(grams, lengths)) if lengths else F.array().cast("array<string>")).alias("key"))
    small = known.limit(BROADCAST + 1).count() <= BROADCAST
    keyed = known.select("surface", "key")
    return each.join(F.broadcast(keyed) if small else keyed, "key").groupBy("id", "surface").agg(F.count(F.lit(1)).alias("n"))


def partial_pairs(texts: DataFrame) -> DataFrame:
    """``texts`` (id, text): (part, whole), ids of texts of which one is a proper, non-empty beginning of the other.

    A text of n characters, 2**k <= n < 2**(k + 1), meets longer ones by a hash of its first 2**k; each text has as many such
    beginnings as n has binary digits."""
    sized = texts.where(F.length("text") > 0).withColumn("k", F.floor(F.log2(F.length("text").cast("double")) + 1e-9).cast("int"))
    head = lambda k: F.xxhash64(k, F.substring(F.col("text"), F.lit(1), F.pow(F.lit(2.0), k).cast("int")))
    part = sized.select(F.col("id").alias("part"), head(F.col("k")).alias("key"))
    whole = sized.select(F.col("id").alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), head)).alias("key"))
    met = part.join(whole, "key").select("part", "whole").where("part <> whole")
    named = lambda id_, text: texts.select(F.col("id").alias(id_), F.col("text").alias(text))
    both = met.join(named("part", "a"), "part").join(named("whole", "b"), "whole")
    return both.where((F.length("a") < F.length("b")) & F.startswith("b", "a")).select("part", "whole")


def bigram_candidates(texts: DataFrame, surfaces: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, surface, score): surfaces of which at least ``share`` of the character bigrams occur in the text."""
    from textloom.functions.text import char_ngrams

    grams = surfaces.select("surface", char_ngrams(F.lower("surface"), 2).alias("g")).withColumn("size", F.size("g")).select("surface", "size", F.explode("g").alias("g"))
    own = texts.select("id", F.explode(char_ngrams(F.lower("text"), 2)).alias("g"))
    met = own.join(F.broadcast(grams) if surfaces.limit(BROADCAST + 1).count() <= BROADCAST else grams, "g")
    return met.groupBy("id", "surface").agg((F.count(F.lit(1)) / F.first("size")).alias("score")).where(F.col("score") >= share)


def overlapping(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Pairs of intervals [start, stop) of one key that overlap."""
    return a.join(b.select(on, F.col("start").alias("other_start"), F.col("stop").alias("other_stop")), on).where("start < other_stop and other_start < stop")
