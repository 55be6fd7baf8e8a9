"""JSON lines, JSON documents and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a JSON lines file; blank lines are skipped, and a malformed line is an error when it is read (``bad_lines``
    tells which).  A missing path gives no rows, or with ``strict`` an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if strict or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value, bad) of every line that is not blank; ``at`` grows along a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.where(F.trim("value") != "").withColumn("bad", ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that hold no JSON object; lines count from 1, blank ones too."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    whole = files.where(F.trim("value") != "")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return whole.where(~good).select("file", (F.col("n") + 1).alias("line"), "value")


def read_jsonl_tail_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files whose writer may have died: a file's last line may be malformed and is left out then (``tail_losses``
    counts these); any other malformed line is an error."""
    lines = _lines(spark, path)
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    kept = lines.join(F.broadcast(last), "file").where(~(F.col("bad") & (F.col("at") == F.col("last"))))
    checked = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), "value")).cast("string")).otherwise(F.col("value"))
    return kept.select(F.from_json(checked, schema).alias("r")).select("r.*")


def tail_losses(spark: SparkSession, path: str) -> DataFrame:
    """(file, bad_lines): 1 for files whose last line is malformed, else 0."""
    return _lines(spark, path).groupBy("file").agg(F.max_by("bad", "at").cast("int").alias("bad_lines"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Null fields are written as nulls.  Rows appear all at once, when the job is committed."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document of all rows, an array in one file; meant for reports, whose size is bounded."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    df.agg(F.to_json(rows, {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str, schema: str, items: str | None = None) -> DataFrame:
    """A JSON document; ``items`` names an array whose elements become the rows."""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc if items is None else doc.select(F.explode(items).alias("r")).select("r.*")


def read_csv_present(spark: SparkSession, path: str, schema: str, text: str, metric: str) -> DataFrame:
    """CSV in which an empty cell of ``text`` is an empty string if ``metric`` is there, and missing otherwise."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn(text, F.when(F.col(metric).isNotNull(), F.coalesce(text, F.lit(""))).otherwise(F.col(text)))


def rubric_options(raw: F.Column) -> F.Column:
    """Options written as ``text（n）`` lines: array<struct<text, score>>."""
    parts = F.regexp_extract_all(raw, F.lit(r"([^（）\n;；]+)（(-?\d+)）"), 0)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*)（", 1)).alias("text"), F.regexp_extract(p, r"（(-?\d+)）$", 1).cast("int").alias("score")))


def sft_rows(df: DataFrame, system: F.Column, human: F.Column, answer: F.Column) -> DataFrame:
    """``conversations`` of system, human and model turns; rows without question or answer are dropped."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    kept = df.where((F.trim(human) != "") & (F.trim(answer) != ""))
    return kept.select(F.array(turn("system", system), turn("human", human), turn("gpt", answer)).alias("conversations"))


def read_markup(text: F.Column, opening: str = "[", closing: str = "]") -> F.Column:
    """Inline entity marks to struct(text, spans): marks go, and each marked stretch is a span of the plain text."""

    @F.udf("struct<text:string,spans:array<struct<start:int,end:int,text:string>>>", useArrow=True)
    def parsed(marked: str) -> dict | None:
        if marked is None:
            return None
        out, spans, begin = [], [], None
        for c in marked:
            if c == opening and begin is None:
                begin = len(out)
            elif c == closing and begin is not None:
                spans.append({"start": begin, "end": len(out), "text": "".join(out[begin:])})
                begin = None
            else:
                out.append(c)
        return {"text": "".join(out), "spans": spans}

    return parsed(text)
