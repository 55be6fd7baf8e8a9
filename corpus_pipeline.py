"""Documents to token files: toxic, repeated and contaminated documents go, sources are mixed, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import table, written
from textloom.llm.decontaminate import reject_contaminated
from textloom.llm.minhash import keep_one
from textloom.llm.mixing import mix_sources
from textloom.llm.tokens import token_files
from textloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic, by a machine trained on ``labels``.  Null and empty texts, and rows without doc_id,
    are judged like others and stay; repeated rows stay or go together; an empty table stays empty."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest doc_id, once, in its text of least hash.  Null and empty
    texts resemble nothing and stay; rows without doc_id stay; very long texts are compared whole."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` is found, searched whole.  Null and empty texts hold none and stay, as do all
    documents where the benchmark is empty."""
    return reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight wants them, in a global random order.  A null source is a source of its own;
    extra columns of any name pass through."""
    return mix_sources(docs).drop("mix_copy", "mix_order")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back.  A null or empty text is its end id alone; rows without doc_id come first; an
    empty table has no file and gives no row."""
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Training, sketches and tokenizers are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over a table that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
