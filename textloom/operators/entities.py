"""Names of a library that a text may have meant: candidates by shared bigrams, scores by sound, spelling and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import sound
from textloom.functions.text import char_ngrams, similarity

# Weights of sound, characters, length, domain and priority; least scores of a hint and of a change by itself.
WEIGHTS = (0.55, 0.25, 0.10, 0.08, 0.02)
FOREIGN_DOMAIN, TOP_PRIORITY = 0.8, 20.0
HINT, AUTO, AUTO_SOUND, MARGIN = 0.80, 0.80, 0.88, 0.12
PHONETIC, LEAST, TOP = (0.8, 0.1, 0.1), 0.52, 5


def slack(length: Column) -> Column:
    """Characters by which a place may be longer or shorter than the name."""
    return F.greatest(F.lit(1), F.least(F.lit(2), F.floor(length * 0.25).cast("int")))


def length_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def _bigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("c"), i, 2), ""))
    each = df.select(key, chars.alias("c")).where(F.size("c") > 0).select(key, F.posexplode(grams).alias("at", "g"))
    return each.select(key, (F.col("at") + 1).alias("at"), "g")


def places(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """``texts`` (id, text), ``entities`` (entity_id, name): (id, entity_id, start, length, observed) of stretches that share a
    bigram with a name where the name would stand, of about its length.  The library goes to the texts; these are joined by
    sorting, since a copy of them for the driver and each executor would grow with the table."""
    named = entities.select("entity_id", "name").where(F.length("name") > 0)
    mine, theirs = _bigrams(texts.where(F.length("text") > 0), "id", "text"), _bigrams(named, "entity_id", "name").withColumnRenamed("at", "name_at")
    starts = mine.join(F.broadcast(theirs), "g").select("id", "entity_id", (F.col("at") - F.col("name_at")).alias("start")).distinct()
    sized = starts.join(F.broadcast(named), "entity_id").withColumn("n", F.length("name"))
    spread = F.sequence(-slack(F.col("n")), slack(F.col("n")))
    each = sized.withColumn("d", F.explode(spread)).withColumn("length", F.col("n") + F.col("d")).where("length > 0 and start >= 0")
    cut = each.join(texts.hint("merge"), "id").where(F.col("start") + F.col("length") <= F.length("text"))
    return cut.select("id", "entity_id", "start", "length", F.substring(F.col("text"), F.col("start") + 1, F.col("length")).alias("observed"))


def fuzzy_matches(texts: DataFrame, entities: DataFrame, domain: str, sounds: DataFrame | None = None, allowed: list[str] | None = None) -> DataFrame:
    """The best place of each name in each text with its score, and what may be done: ``auto`` (clearly meant), ``hint`` or
    ``none``.

    ``entities`` (entity_id, name, entity_type, domain, priority); ``sounds`` (text, sounds array<string>) gives syllables, and
    spelling stands for them where it has none.  Rivals are names of other entities at overlapping places."""
    found = places(texts, entities.select("entity_id", "name")).join(F.broadcast(entities), "entity_id").where(F.lower("observed") != F.lower("name"))
    char = similarity(F.lower("observed"), F.lower("name"))
    if sounds is not None:
        found = found.join(sounds.toDF("observed", "heard"), "observed", "left").join(sounds.toDF("name", "spoken"), "name", "left")
        heard = F.coalesce(sound.similarity(F.col("heard"), F.col("spoken")), char)
    else:
        heard = char
    own = F.when(F.col("domain").isin(domain, "general"), F.lit(1.0)).otherwise(F.lit(FOREIGN_DOMAIN))
    parts = (heard, char, length_similarity(F.length("observed"), F.length("name")), own, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("priority") / TOP_PRIORITY)))
    scored = found.withColumn("sound", heard).withColumn("score", sum((F.lit(w) * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0)))
    best = Window.partitionBy("id", "entity_id").orderBy(F.desc("score"), "start", "length")
    top = scored.withColumn("place", F.row_number().over(best)).where("place = 1 and score >= 0.5")
    top = top.select("id", "entity_id", "name", "entity_type", "start", "length", "observed", "sound", "score")
    rivals = top.select(F.col("id").alias("rid"), F.col("entity_id").alias("rival"), F.col("start").alias("rs"), F.col("length").alias("rl"), F.col("score").alias("rival_score"))
    meets = (F.col("id") == F.col("rid")) & (F.col("entity_id") != F.col("rival")) & (F.col("start") < F.col("rs") + F.col("rl")) & (F.col("rs") < F.col("start") + F.col("length"))
    margin = top.join(rivals.hint("merge"), meets, "left").groupBy(*top.columns).agg((F.col("score") - F.coalesce(F.max("rival_score"), F.lit(0.0))).alias("margin"))
    trusted = F.lit(True) if allowed is None else F.col("entity_type").isin(allowed)
    sure = (F.col("score") >= AUTO) & (F.col("sound") >= AUTO_SOUND) & (F.col("margin") >= MARGIN) & trusted
    return margin.withColumn("action", F.when(sure, "auto").when(F.col("score") >= HINT, "hint").otherwise("none"))


def phonetic_retrieval(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """``spans`` (id, text, sounds), ``entities`` (name, sounds): the best names by sound, characters and length that reach a
    least score, with their place."""
    words = entities.select("name", F.col("sounds").alias("other"), F.explode(F.array_distinct("sounds")).alias("s"))
    met = spans.select("id", "text", "sounds", F.explode(F.array_distinct("sounds")).alias("s")).join(words, "s").dropDuplicates(["id", "name"])
    parts = (sound.similarity(F.col("sounds"), F.col("other")), similarity(F.col("text"), F.col("name")), length_similarity(F.length("text"), F.length("name")))
    scored = met.withColumn("score", sum((F.lit(w) * p for w, p in zip(PHONETIC, parts, strict=True)), F.lit(0.0))).where(F.col("score") >= LEAST)
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "name")))
    return ranked.where(F.col("place") <= TOP).select("id", "name", "score", "place")


def at_word_edges(text: Column, start: Column, length: Column) -> Column:
    """Whether a stretch neither begins nor ends inside a Latin word or a number."""
    word = "^[A-Za-z0-9]$"
    at = lambda i: F.substring(text, i, F.lit(1))
    inside = lambda i: F.when(i < 1, F.lit(False)).otherwise(at(i).rlike(word) & at(i + 1).rlike(word))
    return ~inside(start) & ~inside(start + length)


def verified_text(texts: DataFrame, matches: DataFrame, threshold: float, margin: float = 0.25) -> DataFrame:
    """``texts`` (id, text) with the accepted of ``matches`` (id, entity_id, start, length, observed, name, score) put in, by
    ``functions.policy.verified_choices``."""
    from textloom.functions.policy import verified_choices

    each = matches.groupBy("id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"), "observed", F.col("name").alias("canonical"), "entity_id", "score")).alias("c"))

    @F.udf("string", useArrow=True)
    def chosen(text: str, candidates: list) -> str | None:
        return None if text is None else verified_choices(text, candidates or [], threshold, margin)[0]

    return texts.join(each, "id", "left").select("id", chosen(F.col("text"), F.col("c")).alias("text"))


def shared_bigrams(a: Column, b: Column) -> Column:
    """Share of the bigrams of ``a`` that ``b`` has."""
    grams = char_ngrams(F.lower(a), 2)
    return F.size(F.array_intersect(grams, char_ngrams(F.lower(b), 2))) / F.size(grams)
