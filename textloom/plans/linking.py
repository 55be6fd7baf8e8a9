"""Join, window, set, text, gate and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import edits, gates, numbers, spans
from textloom.functions import text as T
from textloom.operators import joins
from textloom.plans.registry import query
from textloom.sources import files
from textloom.sources.tables import read
from textloom.streaming import sessions


@query("j1_match_records", "SELECT doc_id, quality, coalesce(CASE WHEN length(text) < 5000 THEN lang END, '') AS output FROM labels JOIN documents USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    asr = read(spark, d, "documents").select("doc_id", F.when(F.length("text") < 5000, F.col("lang")).alias("output"))
    return joins.match_records(asr, read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "output")


@query("j2_exact_ids", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.exact_ids(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("j3_resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("j4_cache_lookup", "SELECT o_orderkey, c_name AS response FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    cache = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("response"))
    return read(spark, d, "orders").join(cache, "o_custkey", "left").select("o_orderkey", "response")


@query("j5_entity_aliases", "SELECT s_suppkey, s_name, coalesce((SELECT list_sort(list(DISTINCT p_brand)) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND l_quantity > 49), []) AS aliases FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    aliases = read(spark, d, "lineitem").where("l_quantity > 49").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_brand")
    return joins.with_aliases(read(spark, d, "supplier").select("s_suppkey", "s_name"), aliases, "s_suppkey", "p_brand")


@query("j6_cross_arm_pairs", "SELECT a.user_id, a.v AS view_value, b.v AS click_value FROM (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    arms = read(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.sum("value"))
    return arms.where("view is not null and click is not null").select("user_id", F.col("view").alias("view_value"), F.col("click").alias("click_value"))


@query("j7_review_attachment", "SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE sha256(text)[:1] < '8'")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("basis"))
    reviews = read(spark, d, "labels").join(docs, "doc_id").where(F.substring("basis", 1, 1) < "8").select("doc_id", "basis", "quality")
    return reviews.join(docs, ["doc_id", "basis"]).select("doc_id", "quality")


@query("j8_heldout_exclusion", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')))")
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("key")
    return read(spark, d, "documents").select("doc_id", key).join(read(spark, d, "benchmark").select(key), "key", "left_anti").select("doc_id")


@query("j9_conflicts", "SELECT lower(text) AS source_key, count(DISTINCT lang) AS targets, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.conflicts(read(spark, d, "documents"), F.lower("text"), "lang")


@query("j12_bigram_candidates")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return joins.bigram_candidates(texts, read(spark, d, "part").select(F.col("p_name").alias("surface")).distinct(), 0.6)


@query("j14_trie_longest_match")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").select("doc_id", F.explode(spans.trie_matches(F.lower("text"), ["the", "then", "license", "public license", "idiot"])).alias("m"))
    return found.groupBy("doc_id", "m.surface").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j15_glossary_places",
    """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
       g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS key FROM w)
       SELECT id, surface, count(*) AS n FROM g JOIN (VALUES ('MIT License'), ('Idiot'), ('of the')) s(surface) ON lower(surface) = key GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    glossary = spark.createDataFrame([("MIT License",), ("Idiot",), ("of the",)], "surface string")
    return joins.glossary_places(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), glossary)


@query("j16_source_merge", "SELECT text AS group_key, count(*) AS n, count(DISTINCT source) = 1 AS consistent FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.col("text").alias("group_key")).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("source") == 1).alias("consistent"))


_SPANS_SQL = "SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS start, CAST(l_quantity AS INT) + 5 AS stop FROM lineitem"


@query("j17_span_overlap", f"SELECT a.k, a.n, b.n AS m FROM ({_SPANS_SQL}) a JOIN ({_SPANS_SQL}) b ON a.k = b.k AND a.n < b.n AND a.start < b.stop AND b.start < a.stop")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + 5).alias("stop"))
    other = own.select("k", F.col("n").alias("m"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return own.join(other, "k").where("n < m and start < e2 and s2 < stop").select("k", "n", "m")


@query("u2_multiset_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").exceptAll(orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("u1_concat_inputs", "SELECT doc_id AS id, text, lang FROM documents UNION ALL BY NAME SELECT item_id AS id, text FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang").unionByName(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("u3_id_set_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.exact_ids(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").agg((F.count(F.lit(1)) == 0).alias("equal"))


@query("w1_first_last", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))


@query(
    "w4_top_candidates",
    """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice AS score, row_number() OVER w AS rk, lead(l_extendedprice) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber))
       SELECT l_partkey, l_orderkey, CAST(rk AS INT) AS rk, coalesce((score - nxt) / score, 1.0) AS margin FROM r WHERE rk <= 3""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    ranked = read(spark, d, "lineitem").withColumn("rk", F.row_number().over(own)).withColumn("nxt", F.lead("l_extendedprice").over(own)).where("rk <= 3")
    return ranked.select("l_partkey", "l_orderkey", "rk", F.coalesce((F.col("l_extendedprice") - F.col("nxt")) / F.col("l_extendedprice"), F.lit(1.0)).alias("margin"))


@query("w5_neighbour_context", "SELECT conv_id, turn, lag(role) OVER w AS left_role, lead(role) OVER w AS right_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(own).alias("left_role"), F.lead("role").over(own).alias("right_role"))


@query(
    "w6_fixed_groups",
    """WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)
       SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(floor(place / 3) AS BIGINT) AS grp, string_agg(text, '' ORDER BY place) AS text, count(*) AS n FROM n WHERE conv_id % 2 = 0 OR place < size - 1 GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("chunk"), "text", (F.col("conv_id") % 2 == 0).alias("is_final"))
    return sessions.fixed_groups(chunks)


@query(
    "w8_repetition_runs",
    """WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
       SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM g GROUP BY user_id, event_type, island HAVING count(*) > 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    island = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    runs = read(spark, d, "events").select("user_id", "event_id", "event_type", island.alias("island")).groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return runs.where("n > 2").select("user_id", "event_type", "first_id", "n")


@query("s19_sft_export", "SELECT length(text) AS human, length(answer) AS gpt, count(*) AS n FROM (SELECT text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations) WHERE role = 'user' AND trim(text) <> '' AND trim(answer) <> '' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    rows = files.sft_rows(turns, F.lit("Refine the transcript."), F.col("text"), F.col("answer"))
    return rows.select(F.length(F.col("conversations")[1]["value"]).alias("human"), F.length(F.col("conversations")[2]["value"]).alias("gpt")).groupBy("human", "gpt").agg(F.count(F.lit(1)).alias("n"))


@query("p1_nested_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("p2_extract_text", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN lang = 'en' THEN text END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN source END), '')) AS out FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = F.coalesce(T.blank_to_null(F.when(F.col("lang") == "en", F.col("text"))), T.blank_to_null(F.when(F.col("doc_id") % 2 == 0, F.col("source"))))
    return read(spark, d, "documents").select("doc_id", out.alias("out"))


@query("p3_latency_coalesce", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'click' THEN value + user_id END, CASE WHEN value > 50 THEN value END) AS latency FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, v: F.when(F.col("event_type") == t, v)
    return read(spark, d, "events").select("event_id", F.coalesce(of("view", F.col("value")), of("click", F.col("value") + F.col("user_id")), F.when(F.col("value") > 50, F.col("value"))).alias("latency"))


@query("f3_similarity", "SELECT a.p_partkey, 1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_name")
    return part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", T.similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query("f7_align_and_apply")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every target is rebuilt from its source and the alignment's edits."""
    pairs = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    aligned = pairs.withColumn("edits", edits.align_edits(F.col("a"), F.col("b")))
    return aligned.select("conv_id", "turn", F.size("edits").alias("n_edits"), (edits.apply_edits(F.col("a"), F.col("edits")) == F.col("b")).alias("rebuilt"))


@query("f12_number_normalization")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["百分之三十五", "二零二四年三月五日", "一共三万多个", "二十三", "二三十岁", "万一", "三到五公里", "十有八九"])], "id int, text string")
    return texts.select("id", numbers.normalize_numbers(F.col("text")).alias("text"))


@query("f34_mask_restore")
def _(spark: SparkSession, d: str) -> DataFrame:
    masked = read(spark, d, "documents").select("doc_id", "text", spans.mask_text(F.col("text"), [("idiot", 1)]).alias("m"))
    return masked.select("doc_id", F.size("m.spans").alias("n_spans"), (spans.restore_text(F.col("m.masked"), F.col("m.spans")) == F.col("text")).alias("restored"))


@query("f48_weak_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = l_discount THEN 'neutral' WHEN l_tax > l_discount THEN 'benefit' WHEN l_tax < l_discount THEN 'harm' ELSE 'uncertain' END AS label FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(a == b, "neutral").when(a > b, "benefit").when(a < b, "harm").otherwise("uncertain").alias("label"))


@query("f50_signatures", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS signature FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("signature"))


@query("f52_temperature_transform", "SELECT event_id, 1 / (1 + exp(-ln(q / (1 - q)) / 1.7)) AS p FROM (SELECT event_id, least(greatest(least(1.0, value / 200), 1e-6), 1 - 1e-6) AS q FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.evaluate import tempered

    return read(spark, d, "events").select("event_id", tempered(F.least(F.lit(1.0), F.col("value") / 200), F.lit(1.7)).alias("p"))


@query("f59_url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query(
    "g1_conservative_gate",
    """SELECT doc_id, CASE WHEN trim(text) = '' THEN 'keep' WHEN source = 'src1' THEN 'refine' WHEN contains(trim(text), '  ') THEN 'refine' WHEN quality IS NULL THEN 'refine' WHEN toxic = 1 THEN 'refine'
         WHEN quality = 0 THEN 'refine' WHEN NOT regexp_matches(trim(text), '[!?;]$') THEN 'refine' ELSE 'keep' END AS action FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    hints = F.when(F.col("source") == "src1", F.array(F.lit("hint"))).otherwise(F.array().cast("array<string>"))
    gate = gates.conservative_gate(F.col("text"), F.col("quality").cast("double"), F.coalesce(F.col("toxic") == 0, F.lit(False)), F.lit(True), hints)
    return rows.select("doc_id", gate["action"].alias("action"))


@query("g2_tri_state_gate")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").withColumn("final", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNull())
    empty = F.array().cast("array<string>")
    no = F.lit(False)
    gate = gates.tri_state_gate(F.col("text"), (F.length("text") % 100) / 100.0, F.lit(True), F.lit(True), empty, F.col("final"), F.col("turn") % 2 == 1, F.lit(700.0), F.lit(0.0), no, no)
    return rows.select("conv_id", "turn", gate["action"].alias("action"), gate["reason"].alias("reason"))


@query("g4_learned_veto", "SELECT event_id, CASE WHEN event_type = 'click' AND value / 200 >= 0.5 THEN 'keep' WHEN event_type = 'click' THEN 'refine' ELSE 'keep' END AS action FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "refine").otherwise("keep")
    return read(spark, d, "events").select("event_id", gates.veto(action, F.col("value") / 200, 0.5).alias("action"))


@query("g6_candidate_spans", "WITH e AS (SELECT user_id, event_id, value > 100 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, hot ORDER BY i) AS island FROM e) SELECT user_id, min(i) - 1 AS start, max(i) AS stop FROM g WHERE hot GROUP BY user_id, island")
def _(spark: SparkSession, d: str) -> DataFrame:
    hot = read(spark, d, "events").select("user_id", (F.col("value") > 100).alias("hot"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("i"))
    runs = hot.where("hot").withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
    return runs.groupBy("user_id", "island").agg((F.min("i") - 1).alias("start"), F.max("i").alias("stop")).select("user_id", "start", "stop")


@query("g8_confidence_scope", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'unavailable' WHEN value > 100 THEN 'full_text' WHEN event_type = 'view' THEN 'generated_suffix' ELSE 'current_state' END AS scope FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", gates.confidence_scope(F.col("user_id") % 5, F.col("value") > 100, F.col("event_type") == "view").alias("scope"))


@query("g9_rms_peak", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)) AS rms, list_max(list_transform(embedding, lambda x: abs(x))) AS peak FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", gates.rms(F.col("embedding")).alias("rms"), gates.peak(F.col("embedding")).alias("peak"))


def _updates(spark: SparkSession, d: str, text: F.Column) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("revision_no"), F.timestamp_seconds(F.col("turn") * 2).alias("ts"), text.alias("text"), (F.col("role") == "system").alias("is_final"))


@query("t2_hypothesis_stability")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sessions.stability_of(_updates(spark, d, F.col("text")))


@query("t3_session_memory")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "events").select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("name"), F.least(F.lit(1.0), F.col("value") / 50).alias("confidence"), F.col("event_id").alias("observation_id"))
    return sessions.session_memory(seen)


@query("t7_latest_wins", "SELECT conv_id AS session_id, arg_max(text, (CASE WHEN role = 'system' THEN 1000000 ELSE 0 END) + turn) AS text, arg_max(turn, (CASE WHEN role = 'system' THEN 1000000 ELSE 0 END) + turn) AS revision_no FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_wins(_updates(spark, d, F.col("text")))


@query("t15_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sessions.windowed_counts(read(spark, d, "events"))
