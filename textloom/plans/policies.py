"""Queries over marks, pieces, policies, selections and windows of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import numbers, pieces, policy, quantities, repeats, verdicts
from textloom.operators import entities, select, simjoin
from textloom.plans.registry import query
from textloom.sources import records
from textloom.sources.tables import read
from textloom.streaming import windows


def _turns(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(own).alias("next"))


@query("f20_marks_lost")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("next is not null").select("conv_id", "turn", repeats.marks_lost(F.col("text"), F.col("next")).alias("lost"))


@query("f21_boundary_anomalies", "SELECT doc_id, 0 AS n FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.size(repeats.boundary_anomalies(F.col("text"))).alias("n"))


@query("f28_known_repairs", "SELECT doc_id, length(replace(replace(text, 'of the', 'of'), 'the', 'a')) AS n FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.length(repeats.known_repairs(F.col("text"), [("the", "a"), ("of the", "of")])).cast("long").alias("n"))


@query("f32_bounded_pieces")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, and whether they are the text again."""
    cut = read(spark, d, "documents").select("doc_id", F.trim("text").alias("text"), pieces.bounded_pieces(F.col("text"), 200).alias("p"))
    return cut.select("doc_id", F.size("p").alias("n"), (F.array_join("p", "") == F.col("text")).alias("lossless"))


@query("f45_without_marks", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[；：、;:\"“”‘’''（）()《》【】\\[\\]…—]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", pieces.without_marks(F.col("text")).alias("text"))


@query("f55_cjk_spacing", "SELECT doc_id, regexp_replace(text, '\\s+([,.!?;:%)\\]}])', '\\1', 'g') AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", pieces.cjk_spacing(F.col("text")).alias("text"))


@query("f8_compact_offsets", "SELECT item_id, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.size(pieces.compact_offsets(F.col("text"))).cast("long").alias("n"))


@query(
    "g5_actions",
    """WITH p AS (SELECT event_id, least(1.0, value / 200) AS b, CASE WHEN event_type = 'view' THEN 'defer' ELSE 'refine' END AS native FROM events)
       SELECT event_id, CASE WHEN b >= 0.6 AND (1 - b) / 2 <= 0.15 THEN 'refine' ELSE 'keep' END AS chosen,
         CASE WHEN native = 'refine' AND ((1 - b) / 2 >= 0.4 OR (1 - b) / 2 >= 0.3) THEN 'keep' ELSE native END AS vetoed,
         CASE WHEN native = 'refine' AND b < 0.25 THEN 'keep' ELSE native END AS gained FROM p""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.least(F.lit(1.0), F.col("value") / 200)
    three, two = F.array(b, (1 - b) / 2, (1 - b) / 2), F.array(b, 1 - b)
    native = F.when(F.col("event_type") == "view", "defer").otherwise("refine")
    return read(spark, d, "events").select("event_id", policy.chosen_action(three, 0.6, 0.15).alias("chosen"), policy.vetoed_action(three, native, 0.4, 0.3).alias("vetoed"), policy.gained_action(two, native, 0.25).alias("gained"))


@query("g10_echo_guard", "SELECT doc_id, len(regexp_extract_all(f, 'mitlicense')) <= len(regexp_extract_all(g, 'mitlicense')) AS supported FROM (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS f, regexp_replace(lower(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END), '[^\\p{L}\\p{N}]+', '', 'g') AS g FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    replayed = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    return docs.select("doc_id", policy.echo_supported(F.col("text"), replayed, ["MIT License"]).alias("supported"))


@query("g11_plausibility", "SELECT event_id, CASE WHEN value / 100 - 1 >= 0.5 THEN 'remove' WHEN value / 100 - 1 <= -0.5 THEN 'keep' ELSE 'unresolved' END AS verdict FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", policy.plausible(F.lit(1.0), F.col("value") / 100, 0.5).alias("verdict"))


@query(
    "p14_audit_verdict",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'audit_failed:meaning_preserved' WHEN quality = 0 THEN 'audit_reports_issues' ELSE 'typed_audit_passed' END AS reason FROM labels""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    issues = F.when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    audit = F.struct(F.lit(True).alias("source_valid"), (F.col("toxic") == 0).alias("meaning_preserved"), F.lit(True).alias("cleanup_complete"), issues.alias("issues"), F.lit("x").alias("cleaned_target"))
    return read(spark, d, "labels").select("doc_id", policy.audit_verdict(audit, F.lit("x")).alias("reason"))


@query("p19_native_labels", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'C03' WHEN source = 'src1' THEN 'C02' ELSE 'unclassified' END AS category, lang = 'en' OR source = 'src1' AS eligible FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("lang is not null and source is not null")
    dataset = F.when(F.col("lang") == "en", "Gemma4").otherwise("FCGEC")
    category = F.when(F.col("lang") == "en", "C03").otherwise("C02")
    label = policy.native_label(dataset, category, F.create_map(F.lit("error_type"), F.when(F.col("source") == "src1", "CR").otherwise("CM")))
    return docs.select("doc_id", label.alias("l")).select("doc_id", "l.category", "l.eligible")


@query("p22_source_kind", "SELECT doc_id, CASE WHEN source = 'src0' THEN 'public' WHEN lang = 'en' THEN 'synthetic' ELSE 'unconfirmed' END AS kind FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    origin = F.create_map(F.lit("data_source"), F.when(F.col("source") == "src0", "Open").otherwise("house"))
    return read(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", policy.source_kind(F.when(F.col("lang") == "en", "gemma4").otherwise("other"), origin).alias("kind"))


@query("a29_ordered_distinct", "SELECT user_id, list_aggregate(list_transform(list_sort(list(DISTINCT {'i': f, 't': event_type})), lambda x: x.t), 'string_agg', ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return seen.select("user_id", F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_type"])), ",").alias("types"))


@query("d4_is_duplicate")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return simjoin.is_duplicate(items, read(spark, d, "conversations").select("text"))


@query("d9_balanced_selection")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).where("next is not null")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("category"), F.col("text").alias("source"), F.col("next").alias("target"), F.col("conv_id").alias("grp"))
    rows = rows.withColumn("rank", select.selection_rank(F.col("id") % 2, F.col("id"), "s"))
    quotas = rows.select("category").distinct().withColumn("quota", F.lit(20))
    return select.balanced_selection(rows, quotas, read(spark, d, "benchmark").select("text"))


@query("d28_plan_slots", "SELECT user_id AS id, CASE WHEN u < 0.35 THEN 'short' WHEN u < 0.8 THEN 'medium' ELSE 'long' END AS band FROM (SELECT user_id, CAST('0x' || substr(md5('plan|band|' || user_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM (SELECT DISTINCT user_id FROM events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return select.plan_slots(read(spark, d, "events").select(F.col("user_id").alias("id")).distinct(), {"band": {"short": 0.35, "medium": 0.45, "long": 0.2}})


@query(
    "a18_paired_bootstrap",
    """WITH g AS (SELECT user_id AS grp, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b, count(*) AS n, row_number() OVER (ORDER BY user_id) - 1 AS k FROM events GROUP BY user_id),
       p AS (SELECT r.r AS replicate, CAST('0x' || substr(md5('p:' || r.r || ':' || g.k), 1, 12) AS BIGINT) % (SELECT count(*) FROM g) AS k FROM g, range(0, 40) r(r))
       SELECT replicate, sum(b) / sum(n) - sum(a) / sum(n) AS gain FROM p JOIN g USING (k) GROUP BY replicate""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = lambda t: F.count_if(F.col("event_type") == t)
    groups = read(spark, d, "events").groupBy(F.col("user_id").alias("grp")).agg(hits("click").alias("hits_a"), hits("purchase").alias("hits_b"), F.count(F.lit(1)).alias("total_a")).withColumn("total_b", F.col("total_a"))
    return select.paired_bootstrap(groups, 40)


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a text that grows by a turn at a time."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    grown = F.array_join(F.collect_list("text").over(own), " ")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("revision_no"), grown.alias("text"), F.collect_list("text").over(own).alias("chunks"), (F.col("role") == "system").alias("is_final"))


@query("t4_grouped_reuse")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.grouped_reuse(_updates(spark, d)).groupBy("session_id", "revision_no", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("t5_display")
def _(spark: SparkSession, d: str) -> DataFrame:
    updates = _updates(spark, d)
    spans = F.transform(F.slice("chunks", 1, F.greatest(F.size("chunks") - 1, F.lit(0))), lambda c, i: F.struct(F.concat(c, F.lit(" ")).alias("source"), F.upper(c).alias("clean"), (i % 2 == 0).alias("committed")))
    return windows.display_stream(updates, updates.where("revision_no % 2 = 0").select("session_id", "revision_no", spans.alias("spans"))).select("session_id", "revision_no", F.length("text").alias("shown"), F.length("pending").alias("pending"))


@query("t8_translation_snapshots")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.translation_snapshots(_updates(spark, d))


@query("t10_active_windows")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.active_windows(read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk"), "text"), limit=400)


@query("t14_latest_queue", "SELECT session_id, revision_no, CASE WHEN NOT fin AND lead(ts) OVER (PARTITION BY session_id ORDER BY revision_no) <= started THEN 'superseded' ELSE 'served' END AS state FROM (SELECT conv_id AS session_id, turn AS revision_no, turn * 2 AS ts, turn * 2 + length(text) % 5 AS started, role = 'system' AS fin FROM conversations)")
def _(spark: SparkSession, d: str) -> DataFrame:
    requests = read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("revision_no"), (F.col("turn") * 2).alias("ts"), (F.col("turn") * 2 + F.length("text") % 5).alias("started_at"), (F.col("role") == "system").alias("is_final"))
    return windows.queue_of_latest(requests)


@query("f31_merged_corrections")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.merged_corrections(read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk"), "text"))


@query("s10_entity_list", "SELECT p_partkey AS entity_id, p_name AS canonical_text, CAST(p_size AS INT) AS priority, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 5 AND p_brand IN ('Brand#1', 'Brand#2')")
def _(spark: SparkSession, d: str) -> DataFrame:
    domain = F.when(F.col("p_brand") == "Brand#1", "general").when(F.col("p_brand") == "Brand#2", "parts").otherwise("other")
    entities = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_text"), domain.alias("domain"), F.col("p_size").cast("int").alias("priority"), (F.col("p_size") > 5).alias("enabled"))
    listed = records.entity_list(entities, read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("alias")), "parts")
    return listed.select("entity_id", "canonical_text", "priority", F.size("aliases").cast("long").alias("n"))


@query("s12_library_names", "SELECT DISTINCT p_name AS canonical_text FROM part WHERE p_size > 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.library_names(read(spark, d, "part").select(F.col("p_name").alias("canonical_text"), (F.col("p_size") > 5).alias("enabled")))


@query("f14_numeric_mentions")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(quantities.mentions_of(F.col("text"))).alias("n"))


@query("f15_numbers_preserved")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("next is not null").select("conv_id", "turn", quantities.numbers_preserved(F.col("text"), F.col("next")).alias("kept"))


@query("f37_fuzzy_matches")
def _(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([(1, "cold widget", "part", "parts", 20), (2, "small gadget", "part", "other", 0)], "entity_id int, name string, entity_type string, domain string, priority int")
    heard = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit("widget"), F.lit("wigdet")).alias("text"))
    return entities.fuzzy_matches(heard, named, "parts").select("id", "entity_id", "start", "length", F.round("score", 9).alias("score"), "action")


@query("p13_unsupported_edits")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Edits of each turn's cleaned form that are not in it: none."""
    from textloom.functions import cleanup

    cleaned = read(spark, d, "conversations").select("conv_id", "turn", "text", cleanup.clean(F.col("text")).alias("clean"))
    return cleaned.select("conv_id", "turn", verdicts.unsupported(F.col("text"), F.col("clean")).alias("inserted"))


@query("f11_number_value", "SELECT event_id, CAST(event_id % 10 AS VARCHAR) AS value FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    digit = F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (F.col("event_id") % 10 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", numbers.number_value(digit).alias("value"))
