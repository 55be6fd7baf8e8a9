"""Evaluation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import edits
from textloom.operators import evaluate as E
from textloom.plans.registry import query
from textloom.sources.tables import read

#: Labels as judgements: language is the category, the source the scene, quality the score.
_JUDGED_SQL = "SELECT lang AS category, source AS scene, CASE WHEN toxic = 1 THEN 'failed' ELSE 'success' END AS status, quality AS score, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS m FROM labels JOIN documents USING (doc_id)"


@query(
    "a3_rubric_summary",
    f"""SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(scene) = 0 THEN 'scene' ELSE 'overall' END AS facet, coalesce(category, scene, 'all') AS value,
        count(*) FILTER (status = 'success') AS n, count(*) FILTER (status <> 'success') AS failed,
        CAST(coalesce(sum(score) FILTER (status = 'success'), 0) AS BIGINT) AS score, CAST(coalesce(sum(m) FILTER (status = 'success'), 0) AS BIGINT) AS max_score,
        CASE WHEN coalesce(sum(m) FILTER (status = 'success'), 0) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, sum(score) FILTER (status = 'success') / sum(m) FILTER (status = 'success'))) END AS normalized
        FROM ({_JUDGED_SQL}) GROUP BY GROUPING SETS ((), (category), (scene))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = E.unique_or_raise(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    judged = read(spark, d, "labels").join(docs, "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("scene"), F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"), F.col("quality").alias("score"), F.lit(None).cast("int").alias("max_score"))
    return E.rubric_summary(judged, F.when(F.col("category") == "de", 2).otherwise(1))


_PAIR_SQL = "SELECT conv_id, turn, role, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    hyp = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("ref"), hyp.alias("hyp"))


def _ascii(c: str) -> F.Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")


_CER_SQL = f"""SELECT conv_id, role, levenshtein(regexp_replace(r, ' ', '', 'g'), regexp_replace(h, ' ', '', 'g')) AS errors, length(regexp_replace(r, ' ', '', 'g')) AS units, h IS NULL AS missing
    FROM (SELECT conv_id, turn, role, regexp_replace(lower(ref), '[^a-z0-9 ]', '', 'g') AS r, regexp_replace(lower(coalesce(hyp, '')), '[^a-z0-9 ]', '', 'g') AS h FROM ({_PAIR_SQL}))"""


def _cer(spark: SparkSession, d: str) -> DataFrame:
    bare = _pairs(spark, d).select("conv_id", "turn", "role", F.regexp_replace(_ascii("ref"), " ", "").alias("r"), F.regexp_replace(_ascii("hyp"), " ", "").alias("h"))
    return bare.select("conv_id", "turn", "role", F.levenshtein("r", F.coalesce("h", F.lit(""))).alias("errors"), F.length("r").alias("units"), F.col("h").isNull().alias("missing"))


@query(
    "a4_micro_cer",
    f"""WITH c AS (SELECT conv_id, role, hyp IS NULL AS missing, regexp_replace(regexp_replace(lower(ref), '[^a-z0-9 ]', '', 'g'), ' ', '', 'g') AS r, regexp_replace(regexp_replace(lower(coalesce(hyp, '')), '[^a-z0-9 ]', '', 'g'), ' ', '', 'g') AS h FROM ({_PAIR_SQL}))
        SELECT role, CAST(sum(levenshtein(r, h)) AS BIGINT) AS errors, CAST(sum(length(r)) AS BIGINT) AS units, CASE WHEN sum(length(r)) > 0 THEN sum(levenshtein(r, h)) / sum(length(r)) ELSE 0.0 END AS cer, count(*) FILTER (missing) AS missing FROM c GROUP BY role""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _cer(spark, d).groupBy("role").agg(F.sum("errors").alias("errors"), F.sum("units").alias("units"), E.micro_rate(F.col("errors"), F.col("units")).alias("cer"), F.count_if("missing").alias("missing"))


@query(
    "a5_row_rate",
    f"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(ref), '[^a-z0-9 ]', '', 'g'), ' ', '', 'g') AS r, regexp_replace(regexp_replace(lower(coalesce(hyp, '')), '[^a-z0-9 ]', '', 'g'), ' ', '', 'g') AS h FROM ({_PAIR_SQL}))
        SELECT conv_id, turn, CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r) WHEN levenshtein(r, h) = 0 THEN 0.0 ELSE 1.0 END AS rate FROM c""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _cer(spark, d).select("conv_id", "turn", E.row_rate(F.col("errors"), F.col("units")).alias("rate"))


@query("f1_word_edit_distance")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.filter(F.split(_ascii(c), " +"), lambda w: w != "")
    hyp = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    pairs = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("ref"), hyp.alias("hyp"))
    return pairs.select("conv_id", "turn", edits.token_distance(words("ref"), words("hyp")).alias("errors"), F.size(words("ref")).alias("units"))


@query(
    "f2_wer_units",
    "SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS wer_units, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS cer_units FROM conversations",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    units = F.size(F.expr("regexp_extract_all(lower(text), '([a-z0-9]+)', 1)")).cast("long")
    return read(spark, d, "conversations").select("conv_id", "turn", units.alias("wer_units"), F.length(F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")).cast("long").alias("cer_units"))


_NAMES_SQL = "(VALUES ('the', 1), ('idiot', 2), ('trash', 2), ('license', 3)) g(name, w)"


@query(
    "a6_entity_recall",
    f"""WITH gold AS (SELECT doc_id AS id, lang, name, len(regexp_extract_all(lower(text), name)) AS n FROM documents, {_NAMES_SQL}),
        found AS (SELECT doc_id AS id, name, len(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN replace(lower(text), 'the', 'teh') ELSE lower(text) END, name)) AS m FROM documents, {_NAMES_SQL})
        SELECT lang, CAST(sum(least(n, m)) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS mentions, sum(least(n, m)) / sum(n) AS recall FROM gold JOIN found USING (id, name) WHERE n > 0 GROUP BY lang""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, ["the", "idiot", "trash", "license"])))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text", names.alias("name"))
    times = lambda t: F.size(F.split(F.lower(t), F.col("name"))) - 1
    gold = docs.select("id", "lang", "name", times(F.col("text")).alias("n")).where("n > 0")
    heard = F.when(F.col("id") % 3 == 0, F.replace(F.lower("text"), F.lit("the"), F.lit("teh"))).otherwise(F.col("text"))
    found = docs.select("id", "name", times(heard).alias("n"))
    return E.recall_of(gold, found, "lang")


@query(
    "a7_recovered_lost",
    f"""WITH a AS (SELECT doc_id, name, len(regexp_extract_all(replace(lower(text), 'license', 'licence'), name)) AS x, len(regexp_extract_all(replace(lower(text), 'trash', 'thrash'), name)) AS y FROM documents, {_NAMES_SQL})
        SELECT name, CAST(sum(greatest(0, y - x)) AS BIGINT) AS recovered, CAST(sum(greatest(0, x - y)) AS BIGINT) AS lost FROM a GROUP BY name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, ["the", "idiot", "trash", "license"])))
    docs = read(spark, d, "documents").select("text", names.alias("name"))
    times = lambda a, b: F.size(F.split(F.replace(F.lower("text"), F.lit(a), F.lit(b)), F.col("name"))) - 1
    both = docs.select("name", times("license", "licence").alias("x"), times("trash", "thrash").alias("y"))
    return both.groupBy("name").agg(F.sum(F.greatest(F.lit(0), F.col("y") - F.col("x"))).alias("recovered"), F.sum(F.greatest(F.lit(0), F.col("x") - F.col("y"))).alias("lost"))


@query("a8_domain_arms", "SELECT event_type AS domain, avg(value) FILTER (user_id % 2 = 0) AS arm_a, avg(value) FILTER (user_id % 2 = 1) AS arm_b FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    arms = read(spark, d, "events").withColumn("arm", F.when(F.col("user_id") % 2 == 0, "arm_a").otherwise("arm_b"))
    return arms.groupBy(F.col("event_type").alias("domain")).pivot("arm", ["arm_a", "arm_b"]).agg(F.avg("value"))


_CONF_SQL = "SELECT user_id, least(1.0, value / 200) AS p, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS y FROM events"


def _confidence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_id", "event_type", F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"), F.col("event_type").isin("click", "purchase").cast("int").alias("label"))


@query("a9_confidence_aggregate", f"SELECT user_id, avg(p) AS mean, min(p) AS least, max(p) AS most, product(p) AS prod FROM ({_CONF_SQL}) GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _confidence(spark, d).groupBy("user_id").agg(F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.product("confidence").alias("prod"))


@query("a10_ece", f"SELECT sum(n * abs(c - a)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM ({_CONF_SQL}) GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.ece(_confidence(spark, d))


@query(
    "a11_temperature_fit",
    f"""WITH g AS (SELECT pow(10, -2 + 4 * i / 80.0) AS t FROM range(0, 81) r(i)), q AS (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS q, y FROM ({_CONF_SQL})),
        s AS (SELECT t, -sum(ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-ln(q / (1 - q)) / t)) ELSE 1 - 1 / (1 + exp(-ln(q / (1 - q)) / t)) END)) AS nll FROM q, g GROUP BY t HAVING isfinite(nll))
        SELECT round(t, 6) AS temperature FROM s ORDER BY round(nll, 6), t LIMIT 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.temperature_fit(_confidence(spark, d)).select(F.round("temperature", 6).alias("temperature"))


_SWEEP_SQL = "SELECT event_type AS task, least(1.0, value / 200) AS score, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS benefit, CASE WHEN user_id % 50 = 7 AND value < 190 THEN 1 ELSE 0 END AS harm, user_id FROM events"


def _sweepable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("task"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"), (F.col("user_id") % 3 == 0).cast("int").alias("benefit"), ((F.col("user_id") % 50 == 7) & (F.col("value") < 190)).cast("int").alias("harm"), "user_id")


_GRID = [i / 10 for i in range(11)]


@query(
    "a12_threshold_sweep",
    f"""SELECT task, threshold, count(*) FILTER (score >= threshold) AS taken, CAST(coalesce(sum(benefit) FILTER (score >= threshold), 0) AS BIGINT) AS benefit, CAST(coalesce(sum(harm) FILTER (score >= threshold), 0) AS BIGINT) AS harm
        FROM ({_SWEEP_SQL}), (SELECT i / 10.0 AS threshold FROM range(0, 11) r(i)) GROUP BY task, threshold""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.threshold_sweep(_sweepable(spark, d), _GRID)


@query("a12_best_threshold")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.best_threshold(E.threshold_sweep(_sweepable(spark, d), _GRID))


@query("a33_group_retention")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _sweepable(spark, d).select(F.col("task").alias("cohort"), F.col("user_id").alias("grp"), "score", "benefit")
    return E.group_retention_sweep(rows, _GRID)


@query(
    "a13_classification_report",
    """WITH p AS (SELECT quality AS label, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))
       SELECT label, count(*) AS support, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS recall,
         coalesce(count(*) FILTER (label = predicted) / nullif((SELECT count(*) FROM p q WHERE q.predicted = p.label), 0), 0.0) AS precision,
         2 * count(*) FILTER (label = predicted) / (count(*) + (SELECT count(*) FROM p q WHERE q.predicted = p.label)) AS f1 FROM p GROUP BY label""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return E.classification_report(read(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), "predicted"))


@query(
    "a15_policy_metrics",
    """SELECT o_orderpriority AS arm, count(*) AS calls, sum(o_totalprice) AS cost, count(*) FILTER (o_orderstatus = 'F') AS benefit, count(*) FILTER (o_orderstatus = 'P') AS harm FROM orders GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).alias("calls"), F.sum("o_totalprice").alias("cost"), F.count_if(F.col("o_orderstatus") == "F").alias("benefit"), F.count_if(F.col("o_orderstatus") == "P").alias("harm"))


_GROUPS_SQL = "SELECT l_suppkey AS grp, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY 1"
_BOOT_SQL = f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS k FROM ({_GROUPS_SQL})), n AS (SELECT count(*) AS size FROM g),
    dr AS (SELECT replicate, CAST('0x' || substr(md5('b:' || replicate || ':' || k), 1, 12) AS BIGINT) % size AS k FROM g, n, range(0, 200) r(replicate)),
    rates AS (SELECT replicate, sum(hits) / sum(total) AS rate FROM dr JOIN g USING (k) GROUP BY replicate)"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    groups = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count(F.lit(1)).alias("total"))
    return E.cluster_bootstrap(groups, 200)


@query("a16_bootstrap_rank", f"{_BOOT_SQL} SELECT (SELECT rate FROM rates ORDER BY rate LIMIT 1 OFFSET 4) AS low, (SELECT rate FROM rates ORDER BY rate LIMIT 1 OFFSET 194) AS high")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.interval_by_rank(_rates(spark, d))


@query("a17_bootstrap_linear", f"{_BOOT_SQL} SELECT quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM rates")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.interval_linear(_rates(spark, d))


@query(
    "a19_latency_summary",
    "SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.max("value").alias("most"))


@query(
    "a20_exact_counts",
    f"SELECT count(*) FILTER (ref = hyp) AS literal, count(*) FILTER (lower(trim(ref)) = lower(trim(hyp))) AS normalized, count(hyp) AS n FROM ({_PAIR_SQL})",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).agg(F.count_if(F.col("ref") == F.col("hyp")).alias("literal"), F.count_if(F.lower(F.trim("ref")) == F.lower(F.trim("hyp"))).alias("normalized"), F.count("hyp").alias("n"))


@query("a21_latest_rows", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("a22_completed_samples", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'P')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("done")).where("done").select("o_custkey")


@query("a26_streaming_availability", "SELECT user_id, min(ts) AS first_seen FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_seen"))


@query("a27_session_stats", "SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("kinds"))


@query("a28_manifest", "SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"])
    return read(spark, d, "documents").groupBy("source").agg(F.sha2(F.array_join(parts, ""), 256).alias("digest"))


@query("a30_distribution_summary", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(q).alias("n"), F.sum(q).alias("total"), F.avg(q).alias("mean"), F.percentile(q, F.lit(0.5)).alias("p50"), F.percentile(q, F.lit(0.95)).alias("p95"), F.max(q).alias("most"))


@query("a31_median", "SELECT o_orderpriority, median(o_totalprice) AS median, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median"), F.avg("o_totalprice").alias("mean"))


@query("a32_counter_rollup", "SELECT s_nationkey, sum(s_acctbal) AS total, count(s_acctbal) AS covered, CASE WHEN count(DISTINCT s_name[:8]) = 1 THEN min(s_name[:8]) END AS scalar FROM supplier GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.substring("s_name", 1, 8)
    return read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("total"), F.count("s_acctbal").alias("covered"), F.when(F.min(prefix) == F.max(prefix), F.min(prefix)).alias("scalar"))


@query("a35_duration_strata", "SELECT CASE WHEN l_quantity <= 4 THEN 'to_4' WHEN l_quantity <= 8 THEN '4_to_8' ELSE 'over_8' END AS stratum, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.when(q <= 4, "to_4").when(q <= 8, "4_to_8").otherwise("over_8").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a36_sample_weights",
    """WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS in_rec FROM conversations), t AS (SELECT role, count(DISTINCT conv_id) AS recs FROM conversations GROUP BY role),
       w AS (SELECT conv_id, turn, 1.0 / (in_rec * recs) AS w FROM r JOIN t USING (role)) SELECT conv_id, turn, w / (SELECT avg(w) FROM w) AS weight FROM w""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    recs = turns.groupBy("role").agg(F.count_distinct("conv_id").alias("recs"))
    raw = turns.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).join(recs, "role").select("conv_id", "turn", (1.0 / (F.col("n") * F.col("recs"))).alias("w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("w").alias("mean")))).select("conv_id", "turn", (F.col("w") / F.col("mean")).alias("weight"))
