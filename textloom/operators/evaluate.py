"""Evaluation aggregates: error rates, recall, calibration, thresholds, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; a key that occurs twice is an error."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
    return df


def rubric_summary(scores: DataFrame, default_max: Column) -> DataFrame:
    """``scores`` (category, scene, status, score, max_score) -> one row overall, for each category and for each scene.

    Failed rows count but do not score; normalised = sum of scores / sum of maxima, clamped to [0, 1], and 0 without maxima."""
    ok = F.col("status") == "success"
    rows = scores.withColumn("s", F.when(ok, F.col("score"))).withColumn("m", F.when(ok, F.coalesce("max_score", default_max)))
    sets = rows.groupingSets([[], ["category"], ["scene"]], "category", "scene").agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum("s"), F.lit(0)).alias("score"), F.coalesce(F.sum("m"), F.lit(0)).alias("max_score"), F.grouping("category").alias("gc"), F.grouping("scene").alias("gs")
    )
    facet = F.when(F.col("gc") == 0, "category").when(F.col("gs") == 0, "scene").otherwise("overall")
    share = F.when(F.col("max_score") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / F.col("max_score"))))
    return sets.select(facet.alias("facet"), F.coalesce("category", "scene", F.lit("all")).alias("value"), "n", "failed", F.col("score").cast("long"), F.col("max_score").cast("long"), share.alias("normalized"))


def row_rate(errors: Column, units: Column) -> Column:
    """A single row's rate: without reference units 0 for no error, else 1."""
    return F.when(units > 0, errors / units).when(errors == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def micro_rate(errors: Column, units: Column) -> Column:
    """An aggregate's rate: sums over sums; without reference units 0."""
    return F.when(F.sum(units) > 0, F.sum(errors) / F.sum(units)).otherwise(F.lit(0.0))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of ``rows`` (confidence in [0, 1], label 0/1): equal bins, the last one closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    each = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("label").alias("a"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def tempered(p: Column, t: Column, eps: float = 1e-6) -> Column:
    """sigmoid(logit(clamped p) / t)."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-F.ln(q / (1 - q)) / t))


def temperature_fit(rows: DataFrame, steps: int = 81) -> DataFrame:
    """The temperature in a logarithmic grid over [0.01, 100] of least negative log likelihood; ties go to the smallest.

    The grid is a fixed array exploded beside each row's confidence and label; sums are partial."""
    grid = F.array(*[F.lit(10 ** (-2 + 4 * i / (steps - 1))) for i in range(steps)])
    each = rows.groupBy("confidence", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.explode(grid))
    p = tempered(F.col("confidence"), F.col("t"))
    nll = -F.sum(F.col("n") * F.ln(F.when(F.col("label") == 1, p).otherwise(1 - p)))
    return each.groupBy("t").agg(nll.alias("nll")).agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "t")).alias("best")).select(F.col("best.t").alias("temperature"), F.col("best.nll").alias("nll"))


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold and task of ``rows`` (task, score, benefit, harm as 0/1): how many rows are taken, and what they bring."""
    grid = F.array(*map(F.lit, thresholds))
    taken = F.col("score") >= F.col("threshold")
    return rows.withColumn("threshold", F.explode(grid)).groupBy("task", "threshold").agg(F.count_if(taken).alias("taken"), F.coalesce(F.sum(F.when(taken, F.col("benefit"))), F.lit(0)).alias("benefit"), F.coalesce(F.sum(F.when(taken, F.col("harm"))), F.lit(0)).alias("harm"))


def best_threshold(sweep: DataFrame, cost: float = 0.05) -> DataFrame:
    """For each task the threshold of most benefit less cost among those without harm; ties: fewer rows, then lower threshold."""
    rank = F.struct((F.col("benefit") - F.lit(cost) * F.col("taken")).alias("v"), (-F.col("taken")).alias("n"), (-F.col("threshold")).alias("t"))
    return sweep.where("harm = 0").groupBy("task").agg(F.max(rank).alias("m")).select("task", (-F.col("m.t")).alias("threshold"), (-F.col("m.n")).alias("taken"), F.col("m.v").alias("value"))


def group_retention_sweep(rows: DataFrame, thresholds: Sequence[float], share: float = 0.95) -> DataFrame:
    """The cheapest threshold at which, in every cohort of ``rows`` (cohort, grp, score, benefit 0/1), enough groups keep all
    of their benefit rows; ties: the higher threshold."""
    swept = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("taken", F.col("score") >= F.col("threshold"))
    groups = swept.where("benefit = 1").groupBy("threshold", "cohort", "grp").agg(F.bool_and("taken").alias("kept"))
    cohorts = groups.groupBy("threshold", "cohort").agg((F.count_if("kept") >= F.ceil(F.lit(share) * F.count(F.lit(1)))).alias("enough"))
    fine = cohorts.groupBy("threshold").agg(F.bool_and("enough").alias("fine")).where("fine")
    cost = swept.groupBy("threshold").agg(F.count_if("taken").alias("cost"))
    best = F.min(F.struct("cost", (-F.col("threshold")).alias("t")))
    return fine.join(cost, "threshold").agg(best.alias("m")).select((-F.col("m.t")).alias("threshold"), F.col("m.cost").alias("cost"))


def classification_report(rows: DataFrame) -> DataFrame:
    """(label, support, recall, precision, f1) for each class of ``rows`` (label, predicted)."""
    cells = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = truth.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return both.select("label", "support", (F.col("hit") / F.col("support")).alias("recall"), F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(F.lit(0.0)).alias("precision"), (2 * F.col("hit") / (F.col("support") + F.col("said"))).alias("f1"))


def cluster_bootstrap(groups: DataFrame, replicates: int, seed: str = "b") -> DataFrame:
    """Rates of resampled groups: ``groups`` (grp, hits, total) -> (replicate, rate), one row for each replicate.

    Groups are sums over their rows, numbered densely; draw k of replicate r takes the group whose number is a hash of
    (seed, r, k) modulo their count, so each replicate is a sample of as many groups with replacement.  How often a group is
    drawn is counted before sums are joined, so nothing but counts is exploded."""
    numbered = groups.withColumn("k", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long"))
    n = numbered.agg(F.count(F.lit(1)).alias("size"))
    drawn = numbered.select("k").crossJoin(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "k")), 1, 12), 16, 10).cast("long") % F.col("size")
    times = drawn.groupBy("replicate", pick.alias("k")).agg(F.count(F.lit(1)).alias("times"))
    joined = times.join(numbered, "k")
    return joined.groupBy("replicate").agg((F.sum(F.col("times") * F.col("hits")) / F.sum(F.col("times") * F.col("total"))).alias("rate"))


def interval_by_rank(rates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bounds are values at rank int((n - 1) * p), without interpolation."""
    ranked = rates.select("rate", (F.row_number().over(Window.orderBy("rate")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * F.lit(p)), F.col("rate")))
    return ranked.agg(at(low).alias("low"), at(high).alias("high"))


def interval_linear(rates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return rates.agg(F.percentile("rate", F.lit(low)).alias("low"), F.percentile("rate", F.lit(high)).alias("high"))


def recall_of(gold: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """Clipped mention recall: sum of min(gold, found) over sum of gold, for ``gold`` and ``found`` (id, name, n, ...)."""
    both = gold.join(found.select("id", "name", F.col("n").alias("m")), ["id", "name"], "left")
    return both.groupBy(*by).agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hits"), F.sum("n").alias("mentions")).withColumn("recall", F.col("hits") / F.col("mentions"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
