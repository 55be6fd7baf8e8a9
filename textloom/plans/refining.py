"""Window, cleanup, verdict and sound queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleanup, sound, verdicts, windows
from textloom.plans.registry import query
from textloom.sources.tables import read


@query("f33_source_windows")
def _(spark: SparkSession, d: str) -> DataFrame:
    cut = read(spark, d, "documents").select("doc_id", "text", windows.windows_of(F.col("text")).alias("w"))
    return cut.select("doc_id", F.size("w").alias("n"), (F.array_join("w", "") == F.col("text")).alias("lossless"), F.array_max(F.transform("w", F.length)).alias("longest"))


@query("f30_chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(windows.chunks_of(F.col("text"))).alias("chunk_no", "chunk"))


@query("f27_cleanup", "SELECT conv_id, turn, text AS cleaned FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Latin text shows none of the patterns and passes unchanged."""
    return read(spark, d, "conversations").select("conv_id", "turn", cleanup.clean(F.col("text")).alias("cleaned"))


@query("p12_surface_issues", "SELECT doc_id, len(list_filter([regexp_matches(text, '[.,;:!?]。$')], lambda x: x)) AS issues FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(verdicts.surface_issues(F.col("text"))).cast("long").alias("issues"))


@query("p15_semantic_verdict")
def _(spark: SparkSession, d: str) -> DataFrame:
    response = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"pass": true, "reason": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", verdicts.verdict(response).alias("v")).select("event_id", "v.*")


@query("j13_sound_retrieval")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("sounds", F.split("name", " "))
    spans = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.regexp_replace("p_name", "a", "e"), " ").alias("sounds"))
    return sound.retrieve(spans, names)


@query("f53_logprob_summary", "SELECT vec_id, list_avg(embedding) AS mean, list_min(embedding) AS least, len(list_filter(embedding, lambda x: x < -0.1)) / len(embedding) AS low FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return read(spark, d, "embeddings").select("vec_id", (total / F.size("embedding")).alias("mean"), F.array_min("embedding").alias("least"), (F.size(F.filter("embedding", lambda x: x < F.lit(-0.1).cast("double"))) / F.size("embedding")).alias("low"))


@query("f18_reject_reasons")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's first half as a rewrite of the turn: what the vetoes say."""
    from textloom.functions import guard

    turns = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw"))
    half = F.expr("substring(raw, 1, int(length(raw) / 2))")
    return turns.select("conv_id", "turn", guard.vetoes(F.col("raw"), half).alias("reasons"))
