"""Record-level rules: field fallbacks, predicates, quotas, positions and routing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import gates, spans, windows
from textloom.functions import text as T
from textloom.operators import joins
from textloom.plans.registry import query
from textloom.sources.tables import read


@query("p4_error_text", "SELECT event_id, CASE WHEN event_type = 'error' THEN coalesce(nullif(trim(CASE WHEN value > 60 THEN props ELSE '' END), ''), 'unknown_error') END AS error FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    told = T.blank_to_null(F.when(F.col("value") > 60, F.col("props")).otherwise(""))
    return read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.coalesce(told, F.lit("unknown_error"))).alias("error"))


@query("p11_source_defects", "SELECT doc_id, true AS no_cjk, regexp_matches(text, '[a-z]\\([A-Z]') AS gloss FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", (~F.col("text").rlike("[\\u4e00-\\u9fff]")).alias("no_cjk"), F.col("text").rlike("[a-z]\\([A-Z]").alias("gloss"))


@query(
    "p18_protection_labels",
    """SELECT conv_id, turn, CASE WHEN regexp_extract_all(a, '\\b(?:no|not|nicht|pas)\\b') <> regexp_extract_all(b, '\\b(?:no|not|nicht|pas)\\b') THEN 'negation_changed'
         WHEN regexp_extract_all(a, '[0-9]+') <> regexp_extract_all(b, '[0-9]+') THEN 'number_changed' ELSE 'protected' END AS label
       FROM (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    # word boundaries at ASCII letters and digits only, as the SQL twin has them
    edge = "(?<![0-9A-Za-z_])(?:no|not|nicht|pas)(?![0-9A-Za-z_])"
    same = lambda p: F.regexp_extract_all("a", F.lit(p), 0) != F.regexp_extract_all("b", F.lit(p), 0)
    return pairs.select("conv_id", "turn", F.when(same(edge), "negation_changed").when(same("[0-9]+"), "number_changed").otherwise("protected").alias("label"))


@query("p25_partial_pairs", "SELECT count(*) AS n FROM documents a JOIN documents b ON a.doc_id < b.doc_id AND a.text <> '' AND starts_with(b.text, a.text) AND length(a.text) < length(b.text)")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.partial_pairs(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return pairs.where("part < whole").agg(F.count(F.lit(1)).alias("n"))


@query("w2_distinct_targets", "SELECT conv_id, turn, (SELECT count(DISTINCT role) FROM conversations x WHERE x.conv_id = c.conv_id) AS roles FROM conversations c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(F.collect_set("role").over(Window.partitionBy("conv_id"))).cast("long").alias("roles"))


@query("w3_quota_cutoff", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 10 ELSE 5 END")
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, d, "documents").withColumn("rn", rank).where(F.col("rn") <= F.when(F.col("lang") == "en", 10).otherwise(5)).select("lang", "doc_id")


@query(
    "w7_revision_deltas",
    "SELECT conv_id, turn, length(text) - coalesce(length(lag(text) OVER w), 0) AS grown, coalesce(starts_with(text, lag(text) OVER w), false) AS extends FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") - F.coalesce(F.length(before), F.lit(0))).cast("long").alias("grown"), F.coalesce(F.startswith("text", before), F.lit(False)).alias("extends"))


@query("w9_stable_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey) AS place FROM part ORDER BY place LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "part").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_retailprice", "p_partkey")).cast("long").alias("place"))


@query("u4_array_sets", "SELECT a.item_id, len(list_intersect(a.w, b.w)) AS both, len(list_distinct(list_concat(a.w, b.w))) AS either FROM (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) b ON b.item_id = a.item_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("w"))
    pairs = sets.join(sets.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return pairs.select("item_id", F.size(F.array_intersect("w", "v")).cast("long").alias("both"), F.size(F.array_union("w", "v")).cast("long").alias("either"))


@query("u5_union_with_provenance", "SELECT 'public' AS origin, item_id AS id FROM benchmark UNION ALL SELECT 'synthetic', doc_id FROM documents WHERE lang = 'en'")
def _(spark: SparkSession, d: str) -> DataFrame:
    public = read(spark, d, "benchmark").select(F.lit("public").alias("origin"), F.col("item_id").alias("id"))
    return public.unionByName(read(spark, d, "documents").where("lang = 'en'").select(F.lit("synthetic").alias("origin"), F.col("doc_id").alias("id")))


@query("f35_key_suffix", "SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text || ' <KEY>[a, b] ' ELSE text END, '\\s*<KEY>\\[[^\\]]*\\]\\s*$', '')) AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" <KEY>[a, b] "))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(marked, r"\s*<KEY>\[[^\]]*\]\s*$", "")).alias("text"))


@query("f51_confidence_evidence", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN least(1.0, value / 100) END, CASE WHEN event_type = 'click' THEN exp(-value / 100) END) AS p, event_type = 'view' AS calibrated FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    explicit = F.when(F.col("event_type") == "view", F.least(F.lit(1.0), F.col("value") / 100))
    logprob = F.when(F.col("event_type") == "click", F.exp(-F.col("value") / 100))
    return read(spark, d, "events").select("event_id", F.coalesce(explicit, logprob).alias("p"), explicit.isNotNull().alias("calibrated"))


@query("f58_clamp", "SELECT c_custkey, least(5000.0, greatest(0.0, c_acctbal)) AS balance FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.least(F.lit(5000.0), F.greatest(F.lit(0.0), F.col("c_acctbal"))).alias("balance"))


@query("a14_window_location_metrics", "SELECT o_orderpriority, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM (SELECT o_orderpriority, bool_or(l_returnflag = 'R') AS hit FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"))
    joined = read(spark, d, "orders").join(hits, "o_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("a34_mention_positions", "SELECT doc_id, instr(lower(text), 'the') - 1 AS first, length(text) - (instr(lower(text), 'the') - 1) - 3 AS remaining FROM documents WHERE contains(lower(text), 'the')")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr(F.lower("text"), "the") - 1
    return read(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", at.cast("long").alias("first"), (F.length("text") - at - 3).cast("long").alias("remaining"))


@query("d6_canonical_placeholders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Masked texts with placeholders numbered by first appearance are the same for the same text."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(spans.canonical_placeholders)

    masked = read(spark, d, "documents").select("doc_id", spans.mask_text(F.col("text")).alias("m"))
    return masked.select("doc_id", F.md5(canonical("m.masked")).alias("key"))


@query("g3_confidence_supplement", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'refine' WHEN user_id % 4 = 0 THEN 'refine' WHEN value < 20 THEN 'refine' ELSE 'keep' END AS action FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A supplement only adds review: missing evidence or low confidence turns keep into refine, never the other way."""
    action = F.when(F.col("event_type") == "click", "refine").otherwise("keep")
    evidence = F.when(F.col("user_id") % 4 != 0, F.col("value"))
    return read(spark, d, "events").select("event_id", F.when(evidence.isNull() | (evidence < 20), "refine").otherwise(action).alias("action"))


@query("g7_segment_rotation", "SELECT event_id, value >= 200 OR (value >= 100 AND user_id % 2 = 0) OR event_type = 'signup' AS ends FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", gates.rotate(F.col("value"), 100.0, 200.0, F.col("user_id") % 2 == 0, F.col("event_type") == "signup").alias("ends"))


@query("t1_chunk_sessions")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as a growing hypothesis: chunks come out as soon as they are complete."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chunker, text, out = windows.Chunker(), "", []
        for r in rows.sort_values("turn").itertuples():
            text += r.text.strip() + " "
            out += [(key[0], int(r.turn), i, c) for i, c in chunker.update(text)]
        return pd.DataFrame(out, columns=["conv_id", "turn", "chunk_no", "chunk"])

    return read(spark, d, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(whole, "conv_id long, turn long, chunk_no int, chunk string")
