"""Curation queries: distributions, filters, near-dedup, quotas and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import curate, simjoin
from textloom.plans.registry import query
from textloom.sources.tables import read


@query("d3_greedy_near_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("full").alias("part"), "text")
    return simjoin.near_dedup(items).withColumnRenamed("id", "doc_id")


@query("j10_ngram_jaccard_join")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return simjoin.linked_items(docs, lambda x: simjoin.similar_pairs(x.withColumn("part", F.lit("full")))).withColumnRenamed("id", "doc_id")


@query("j11_minhash_lsh_join")
def _(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.linked_items(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), simjoin.lsh_pairs).withColumnRenamed("id", "doc_id")


@query("d5_lsh_near_index")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return simjoin.near_index(docs).withColumnRenamed("id", "doc_id")


@query(
    "d1_char_ngrams",
    """SELECT item_id, count(DISTINCT g) AS n_grams, min(g) AS first_gram FROM (
         SELECT item_id, unnest(CASE WHEN length(trim(text)) < 3 THEN [trim(text)]
           ELSE list_transform(range(1, length(trim(text)) - 1), lambda i: substr(trim(text), CAST(i AS INT), 3)) END) AS g FROM benchmark) GROUP BY item_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    grams = read(spark, d, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    return grams.select("item_id", F.size("g").cast("long").alias("n_grams"), F.array_min("g").alias("first_gram"))


@query(
    "d2_jaccard_words",
    """WITH b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
       SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS jaccard
       FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.w, y.w)) > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    words = sets.select("item_id", F.explode("w").alias("word"))
    pairs = words.toDF("a", "word").join(words.toDF("b", "word"), "word").where("a < b").select("a", "b").distinct()
    both = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    return both.select("a", "b", T.jaccard(F.col("wa"), F.col("wb")).alias("jaccard"))


@query(
    "a1_distribution",
    """SELECT CASE WHEN GROUPING(lang) = 0 THEN 'language' WHEN GROUPING(source) = 0 THEN 'scene' WHEN GROUPING(frag) = 0 THEN 'is_fragment' ELSE 'total' END AS facet,
              coalesce(lang, source, frag, 'all') AS value, count(*) AS n
       FROM (SELECT coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CASE WHEN n_chars < 200 THEN 'true' ELSE 'false' END AS frag FROM documents)
       GROUP BY GROUPING SETS ((lang), (source), (frag), ())""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), (F.col("n_chars") < 200).cast("string").alias("frag"))
    sets = docs.groupingSets([["lang"], ["source"], ["frag"], []], "lang", "source", "frag").agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.grouping("frag").alias("gf"))
    facet = F.when(F.col("gl") == 0, "language").when(F.col("gs") == 0, "scene").when(F.col("gf") == 0, "is_fragment").otherwise("total")
    return sets.select(facet.alias("facet"), F.coalesce("lang", "source", "frag", F.lit("all")).alias("value"), "n")


@query(
    "a2_validate_distribution",
    """SELECT t.lang, coalesce(n, 0) / (SELECT count(*) FROM documents) AS actual, t.target, abs(coalesce(n, 0) / (SELECT count(*) FROM documents) - t.target) > 0.05 AS off_target
       FROM (SELECT col0 AS lang, CAST(col1 AS DOUBLE) AS target FROM (VALUES ('en', 0.55), ('fr', 0.2), ('de', 0.15), ('zh', 0.1))) t LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a ON a.lang = t.lang""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("en", 0.55), ("fr", 0.2), ("de", 0.15), ("zh", 0.1)], "lang string, target double")
    counts = read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    actual = F.coalesce("n", F.lit(0)) / F.col("total")
    return targets.join(counts, "lang", "left").crossJoin(F.broadcast(total)).select("lang", actual.alias("actual"), "target", (F.abs(actual - F.col("target")) > 0.05).alias("off_target"))


@query(
    "a23_duplicate_inputs",
    """SELECT count(*) AS distinct_inputs, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) FILTER (targets > 1) AS conflicting
       FROM (SELECT text, count(*) AS n, count(DISTINCT source) AS targets FROM documents GROUP BY text)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    each = read(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("targets"))
    return each.agg(F.count(F.lit(1)).alias("distinct_inputs"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("targets") > 1).alias("conflicting"))


_AUDIT_SQL = """SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END,
    CASE WHEN text LIKE '%  %' THEN 'double_blank' END, CASE WHEN contains(text, '!!') THEN 'shouting' END], lambda x: x IS NOT NULL)) AS code FROM documents"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("n_chars") > 10000, "long"), F.when(F.col("text").contains("  "), "double_blank"), F.when(F.col("text").contains("!!"), "shouting")))
    return read(spark, d, "documents").select("doc_id", F.explode(codes).alias("code"))


@query("a24_audit_errors", f"SELECT code, count(*) AS n FROM ({_AUDIT_SQL}) GROUP BY code")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("a24_audit_examples", f"SELECT code, doc_id FROM (SELECT code, doc_id, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS rn FROM ({_AUDIT_SQL})) WHERE rn <= 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("doc_id"))).where("rn <= 50").select("code", "doc_id")


@query("a25_status_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    pivot = read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return pivot.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query(
    "p5_language_default",
    "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang WHEN doc_id % 2 = 0 THEN 'de' WHEN starts_with(source, 'src1') THEN 'en' ELSE 'zh' END AS language FROM documents",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    item = F.when(F.col("lang").isin("en", "fr"), F.col("lang"))
    meta = F.when(F.col("doc_id") % 2 == 0, "de")
    scene = F.regexp_replace("source", "^src1", "english_1")
    return read(spark, d, "documents").select("doc_id", T.language_default(item, meta, scene).alias("language"))


@query("p6_phenomena_merge", "SELECT doc_id, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS merged FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    merged = F.array_distinct(F.concat(F.array("lang", "source"), F.array("source", "lang")))
    return read(spark, d, "documents").select("doc_id", F.array_join(merged, ",").alias("merged"))


@query("p7_id_namespacing", "SELECT c_custkey, c_mktsegment || '_' || c_custkey AS id, c_name AS kept FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", T.namespaced_id(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("id"), T.namespaced_id(F.col("c_name"), F.col("c_mktsegment")).alias("kept"))


_ASSEMBLE_SQL = """CASE WHEN trim(text) = '' THEN 'skipped_empty' WHEN length(trim(text)) < CASE WHEN lang = 'en' THEN 60 WHEN source IN ('src1', 'src2') THEN 80 ELSE 100 END THEN 'skipped_short'
    WHEN regexp_matches(text, '[0-9]{16}') THEN 'skipped_numeric' ELSE 'kept' END"""


@query("p9_assemble_counters", f"SELECT source AS scene, {_ASSEMBLE_SQL} AS reason, count(*) AS n FROM documents GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    least = F.when(F.col("lang") == "en", 60).when(F.col("source").isin("src1", "src2"), 80).otherwise(100)
    body = F.trim("text")
    reason = F.when(body == "", "skipped_empty").when(F.length(body) < least, "skipped_short").when(F.col("text").rlike("[0-9]{16}"), "skipped_numeric").otherwise("kept")
    return read(spark, d, "documents").groupBy(F.col("source").alias("scene"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_min_length", "SELECT doc_id, CASE WHEN lang = 'en' THEN 6 WHEN source IN ('src3', 'src4') THEN 8 ELSE 10 END AS least FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.min_length(F.col("source"), F.col("lang"), ["src3", "src4"]).alias("least"))


@query(
    "p10_qc_reason",
    """SELECT conv_id, turn, CASE WHEN trim(target) = '' THEN 'blank' WHEN length(target) > 1.8 * length(text) AND length(target) > 30 THEN 'expansion'
         WHEN length(trim(target)) <= 2 THEN 'too_short' ELSE 'ok' END AS qc_reason
       FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "conversations").withColumn("target", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("target is not null")
    n = F.length("target")
    reason = F.when(F.trim("target") == "", "blank").when((n > F.lit(1.8) * F.length("text")) & (n > 30), "expansion").when(F.length(F.trim("target")) <= 2, "too_short").otherwise("ok")
    return pairs.select("conv_id", "turn", reason.alias("qc_reason"))


@query(
    "p17_sequences_preserved",
    """SELECT d.doc_id, regexp_extract_all(d.text, '[0-9]+') = regexp_extract_all(e.text, '[0-9]+') AS same_numbers
       FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    numbers = read(spark, d, "documents").select("doc_id", F.expr("regexp_extract_all(text, '([0-9]+)', 1)").alias("n"))
    return numbers.join(numbers.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m")), "doc_id").select("doc_id", (F.col("n") == F.col("m")).alias("same_numbers"))


@query("p23_keyword_evidence", "SELECT doc_id, list_filter(['idiot', 'license', 'the', 'version'], lambda k: contains(lower(text), k)) AS keywords FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ["idiot", "license", "the", "version"]))
    return read(spark, d, "documents").select("doc_id", F.filter(words, lambda k: F.contains(F.lower("text"), k)).alias("keywords"))


@query("p26_completed_ids", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last <> 'error'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last <> 'error'").select("user_id")


@query("p27_scene_allowlist", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src3', 'src7')")
def _(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.createDataFrame([("src0", 0.5), ("src1", 0.0), ("src3", 0.2), ("src7", 0.3)], "source string, weight double").where("weight > 0")
    return read(spark, d, "documents").join(F.broadcast(weights), "source", "left_semi").select("doc_id")


@query("d7_seed_dedupe", "SELECT lang, key, min(doc_id) AS doc_id FROM (SELECT lang, doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents) GROUP BY lang, key")
def _(spark: SparkSession, d: str) -> DataFrame:
    keyed = read(spark, d, "documents").select("lang", "doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("key"))
    first = F.row_number().over(Window.partitionBy("lang", "key").orderBy("doc_id"))
    return keyed.withColumn("rn", first).where("rn = 1").select("lang", "key", "doc_id")


@query(
    "d8_ledger_status",
    """WITH e AS (SELECT event_id AS seq, event_type AS category, user_id AS norm, CAST(floor(value / 60) AS BIGINT) AS target, value < 200 AS ok FROM events),
       c AS (SELECT category, norm, count(DISTINCT target) > 1 AS clash, min(seq) AS first FROM e WHERE ok GROUP BY 1, 2),
       m AS (SELECT e.*, clash, ok AND NOT clash AND seq = first AS cand FROM e LEFT JOIN c USING (category, norm)),
       r AS (SELECT *, sum(CASE WHEN cand THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY seq) AS rk FROM m)
       SELECT seq, category, CAST(norm AS VARCHAR) AS norm, CASE WHEN NOT ok THEN 'rejected' WHEN clash THEN 'conflict' WHEN NOT cand THEN 'duplicate' WHEN rk > 2 THEN 'quota_full' ELSE 'accepted' END AS status FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("source"), F.floor(F.col("value") / 60).cast("string").alias("target"), F.when(F.col("value") < 200, "pass").otherwise("fail").alias("verdict"))
    quotas = rows.select("category").distinct().withColumn("quota", F.lit(2))
    return curate.ledger_status(rows, quotas)


@query(
    "d10_largest_remainder",
    """WITH w AS (SELECT lang AS name, count(*) AS weight FROM documents GROUP BY lang),
       x AS (SELECT name, 97 * weight / (SELECT sum(weight) FROM w) AS exact FROM w),
       r AS (SELECT name, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, name) AS rk FROM x)
       SELECT name, CAST(base + CASE WHEN rk <= 97 - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    weights = read(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("weight")).withColumn("position", F.col("name"))
    return curate.largest_remainder_quotas(weights, 97)


@query(
    "d12_take_until_target",
    "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE n_chars > 300) WHERE rn <= 20",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    targets = docs.select("lang").distinct().withColumn("target", F.lit(20))
    return curate.take_until(docs, "lang", "doc_id", "n_chars > 300", targets).select("lang", "doc_id")


@query("d13_reservoir", "SELECT doc_id FROM documents ORDER BY sha256('s|' || doc_id), doc_id LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").orderBy(curate.hash_order(F.col("doc_id")), "doc_id").limit(25).select("doc_id")


@query(
    "d14_representatives",
    """SELECT DISTINCT doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY source UNION ALL
         SELECT min(doc_id) FROM documents GROUP BY lang HAVING count(*) <= greatest(1, (SELECT count(*) FROM documents) * 0.2))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    scenes = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    rare = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") <= F.greatest(F.lit(1.0), F.col("total") * 0.2))
    return scenes.union(rare.select("doc_id")).distinct()


@query(
    "d15_round_robin",
    """SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('s|' || doc_id), doc_id) AS INT) AS turn FROM documents) ORDER BY turn, lang LIMIT 40""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return curate.round_robin(read(spark, d, "documents"), "lang", "doc_id", 40).select("doc_id", "lang", "turn")


_BUCKET_SQL = "CASE WHEN length(text) <= 20 THEN 'short' WHEN length(text) <= 50 THEN 'medium' WHEN length(text) <= 100 THEN 'long' ELSE 'very_long' END"


@query("d17_length_bucket", f"SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy(T.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d16_stratified_split",
    f"""WITH s AS (SELECT doc_id, lang, {_BUCKET_SQL} AS bucket FROM documents),
        r AS (SELECT *, count(*) OVER (PARTITION BY lang, bucket) AS n, row_number() OVER (PARTITION BY lang, bucket ORDER BY sha256('s|' || doc_id), doc_id) AS rk FROM s)
        SELECT doc_id, rk <= CASE WHEN floor(n * 0.1) = 0 AND n >= 5 THEN 1 ELSE floor(n * 0.1) END AS held FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", T.length_bucket(F.col("text")).alias("bucket"))
    return curate.stratified_split(docs, ["lang", "bucket"], "doc_id", 0.1).select("doc_id", "held")


@query("d18_intent_key", "SELECT conv_id, turn, regexp_replace(trim(text), '[。\\s]+$', '') AS key FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.intent_key(F.lit(None).cast("string"), F.lit("  "), F.col("text")).alias("key"))


@query("d19_grouped_split")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("bucket", T.length_bucket(F.col("text")))
    return curate.grouped_split(turns, "conv_id", ["role", "bucket"], 0.2).select("conv_id", "turn", "held")


@query(
    "d20_hash_split",
    """SELECT doc_id, CASE WHEN h < 900 THEN 'train' WHEN h < 950 THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT doc_id, CAST('0x' || substr(sha256(lang || '|' || source || '|' || text), 1, 12) AS BIGINT) % 1000 AS h FROM documents)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", curate.hash_split(F.col("lang"), F.col("source"), F.col("text")).alias("split"))


@query("d21_components")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share their text or its first hundred characters hang together."""
    docs = read(spark, d, "documents")
    by_text = docs.withColumn("b", F.min("doc_id").over(Window.partitionBy("text"))).select(F.col("doc_id").alias("a"), "b")
    by_head = docs.withColumn("b", F.min("doc_id").over(Window.partitionBy("text"))).select(F.col("doc_id").alias("a"), "b")
    comp = simjoin.components(by_text.union(by_head).where("a <> b"))
    return docs.select("doc_id").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query(
    "d22_leak_check",
    """WITH s AS (SELECT text, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) % 10 < 8 AS train FROM documents)
       SELECT md5(text) AS key, count(*) AS n FROM s GROUP BY text HAVING count(DISTINCT train) > 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    side = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12), 16, 10).cast("long") % 10 < 8
    sides = read(spark, d, "documents").withColumn("train", side).groupBy("text").agg(F.min("train").alias("lo"), F.max("train").alias("hi"), F.count(F.lit(1)).alias("n"))
    return sides.where("lo <> hi").select(F.md5("text").alias("key"), "n")


@query("d23_spaced_sample")
def _(spark: SparkSession, d: str) -> DataFrame:
    return curate.spaced(read(spark, d, "part").select("p_partkey"), "p_partkey", 64)


@query("d24_capped_queue", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn"))
    return read(spark, d, "conversations").withColumn("rn", rank).where("rn <= 2").select("conv_id", "turn")


@query("d25_set_cover")
def _(spark: SparkSession, d: str) -> DataFrame:
    clips = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_partkey").alias("term"))
    return spark.createDataFrame([(i, c) for i, c in enumerate(curate.set_cover(clips, 5))], "place int, clip long")


@query("d27_capped_seeds", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', sha256('s|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("lang") != "en", curate.hash_order(F.col("doc_id")), "doc_id"))
    return read(spark, d, "documents").withColumn("rn", rank).where("rn <= 5").select("source", "doc_id")
