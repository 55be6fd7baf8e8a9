"""The corpus pipeline stage by stage, against what each stage's operator says of its own input."""

import os
import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from textloom.llm import decontaminate, minhash, registry, toxicity
from textloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").withColumn("score", F.lit("x"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == before.columns
        out[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = out["toxicity"]
    scored = toxicity.toxicity(before, table(spark, FOLDER, "labels"))
    assert ids(after) == {r.doc_id for r in scored.where("predicted = 0").collect()}
    before, after = out["near_dedup"]
    assert ids(after) == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
    before, after = out["decontamination"]
    found = decontaminate.contamination(before, table(spark, FOLDER, "benchmark"))
    assert ids(after) == {r.doc_id for r in found.where("not contaminated").collect()}
    before, after = out["mixing"]
    assert ids(after) <= ids(before) and abs(after.count() / before.count() - 1) < 0.3
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == docs.count()
    assert tokens.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first() == tokens.agg(F.sum("n_tokens"), F.sum("n_tokens")).first()


def test_run_repeats(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) for _ in range(2))
    assert one == two and len(one) > 100


def _columns(docs):
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(["rows", "hash", "id", "row", "key", "kept", "pieces", "cdf", "mix_n", "n_items", "predicted", "component_id", "toxic"])})


def test_stages_with_odd_rows(spark):
    """Null ids, null and empty texts, repeated rows and columns of any name go through every stage."""
    some = table(spark, FOLDER, "documents").orderBy("doc_id").limit(60)
    extra = [(None, "no id here", "en", "src1", 1), (700_001, None, "en", "src1", 1), (700_002, "", None, None, None), (700_003, "twice the same row of some words", "en", "src2", 1), (700_003, "twice the same row of some words", "en", "src2", 1), (700_004, "two texts of one id, this one", "en", "src2", 1), (700_004, "and here is quite another text", "en", "src2", 1), (700_005, "long " * 60_000, "en", "src0", 1)]
    docs = _columns(some.union(spark.createDataFrame(extra, some.schema)))
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), before.schema)
        seen[name] = docs.collect()
        assert docs.columns == before.columns
    ids = lambda name: sorted(str(r.doc_id) for r in seen[name] if r.doc_id is None or r.doc_id >= 700_000)
    assert ids("toxicity") == sorted(["None", "700001", "700002", "700003", "700003", "700004", "700004", "700005"])
    assert ids("near_dedup") == ids("decontamination") == ["700001", "700002", "700003", "700004", "700005", "None"]
    assert {r.predicted for r in seen["mixing"]} == {10} and {r["rows"] for r in seen["mixing"]} == {0}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == docs.count() and tokens.where("n_tokens < 1").count() == 0


def test_stages_of_an_empty_table(spark):
    docs = _columns(table(spark, FOLDER, "documents").limit(0))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_work_tables_of_a_stage_go(spark):
    """After a stage only what its result reads is left in the shared folder."""
    root = os.path.join(spark.conf.get("spark.checkpoint.dir"), "textloom")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.near_dedup(spark, table(spark, FOLDER, "documents"), FOLDER)
    assert out.count() > 100 and [x.split("-")[0] for x in set(os.listdir(root)) - before] == ["kept"]


def test_entry_without_the_tokenizers():
    """What cannot be imported is left out, and the other queries stay."""
    code = "import sys; sys.modules['public_tokenizers'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'op1_toxicity' in q)" % os.path.dirname(corpus_pipeline.__file__)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 140 and out[1:] == ["False", "True"]


def test_registry_has_the_ten():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert os.path.exists(FOLDER)


def test_workers_give_memory_back(monkeypatch):
    """At the end of a task, failed ones too, what it has freed goes back to the system."""
    from textloom.llm import common

    seen = []
    monkeypatch.setattr(common, "_trim", seen.append)
    assert list(common._tidy(iter([1, 2]), function=lambda batches: (x + 1 for x in batches))) == [2, 3] and seen == [0]
    try:
        list(common._tidy(iter([0]), function=lambda batches: (1 // x for x in batches)))
    except ZeroDivisionError:
        assert seen == [0, 0]
