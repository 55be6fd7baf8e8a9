"""Record sources with their contracts: entity libraries, scene files, rubrics, references and audio tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Domain whose entities every domain sees.
GENERAL = "general"


def entity_list(entities: DataFrame, aliases: DataFrame, domain: str) -> DataFrame:
    """Enabled entities of a domain and of the general one, with their aliases in order of the alias, ranked by priority (high
    first) and id."""
    own = entities.where(F.col("enabled") & F.col("domain").isin(domain, GENERAL))
    folded = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    listed = own.join(folded, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return listed.orderBy(F.desc("priority"), "entity_id")


def library_names(entities: DataFrame) -> DataFrame:
    return entities.where("enabled").select("canonical_text").distinct()


def scene_records(spark: SparkSession, folder: str, scenes: Sequence[str], kinds: Sequence[str] = ("asr_sim", "clean"), schema: str = "id string, input string") -> DataFrame:
    """Records of one file for each enabled scene: of ``folder/kind/scene.jsonl`` the first kind that is there.  Adds ``scene``
    and ``kind``; scenes that are not listed are not read."""
    out = spark.createDataFrame([], schema).withColumns({"scene": F.lit(""), "kind": F.lit("")}).limit(0)
    for scene in dict.fromkeys(scenes):
        for kind in kinds:
            try:
                found = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{kind}/{scene}.jsonl")
            except AnalysisException as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            out = out.union(found.withColumns({"scene": F.lit(scene), "kind": F.lit(kind)}))
            break
    return out


_OPTION = r"([^（）\n;；]+?)（(-?\d+)）"
CATEGORIES = ("content", "format", "filter", "rephrase")


def rubric_question_faults(question: Column) -> Column:
    """What is wrong with a question struct (id, category, question, evidence, options as text): empty, or the first fault."""
    blank = lambda c: F.coalesce(F.trim(question[c]) == "", F.lit(True))
    rest = F.regexp_replace(question["options"], _OPTION, "")
    fault = F.when(blank("id"), "missing id").when(~F.coalesce(question["category"].isin(*CATEGORIES), F.lit(False)), "invalid category")
    fault = fault.when(blank("question"), "missing question").when(blank("evidence"), "missing evidence").when(blank("options"), "missing options")
    return fault.when(F.regexp_replace(rest, r"[\s，,;；]", "") != "", "invalid options").otherwise("")


def rubric_faults(rows: DataFrame) -> DataFrame:
    """(source_record_id, fault) of rubric rows (source_record_id, audio, scene, oral, clean, qa) that break the contract."""
    missing = F.concat_ws("", *[F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"missing {c};")) for c in ("source_record_id", "audio", "scene", "oral", "clean")])
    ids = F.transform("qa", lambda q: q["id"])
    qa = F.when(F.coalesce(F.size("qa") <= 0, F.lit(True)), "missing qa;").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate question id;").otherwise("")
    each = F.array_join(F.filter(F.transform("qa", rubric_question_faults), lambda x: x != ""), ";")
    return rows.select("source_record_id", F.concat(missing, qa, F.coalesce(each, F.lit(""))).alias("fault")).where("fault <> ''")


def reference_pairs(rows: DataFrame) -> DataFrame:
    """Sentences with several references, one row each: ``rows`` (id, sentence, references array<struct<text, operations
    array<int>>>).  ``valid`` tells whether all positions that the operations name lie in the sentence; a sentence without
    references is its own."""
    own = F.array(F.struct(F.col("sentence").alias("text"), F.array().cast("array<int>").alias("operations")))
    each = rows.select("id", "sentence", F.posexplode(F.when(F.coalesce(F.size("references") > 0, F.lit(False)), F.col("references")).otherwise(own)).alias("reference_no", "r"))
    inside = F.forall(F.coalesce("r.operations", F.array().cast("array<int>")), lambda i: i.between(0, F.length("sentence") - 1))
    return each.select("id", "reference_no", F.col("sentence").alias("input"), F.col("r.text").alias("reference"), inside.alias("valid"))


def audio_rows(spark: SparkSession, path: str, columns: Sequence[str] = ("id", "audio", "text"), group: Column | None = None) -> DataFrame:
    """Rows of an audio table in Parquet with ``source_group``, what must not be split between sets: a column of the table, or else
    the id up to its last separator."""
    rows = spark.read.parquet(path)
    told = group if group is not None else F.regexp_replace(F.col("id").cast("string"), "[-_/][^-_/]*$", "")
    return rows.select(*columns, told.alias("source_group"))
