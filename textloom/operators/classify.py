"""A text classifier on character n-grams: TF-IDF and logistic regression with balanced weights, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed columns, and n-gram lengths.
FEATURES, LENGTHS = 1 << 16, (2, 3, 4)


def with_grams(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``grams``: character n-grams of the lower-cased text, as often as they come."""
    # the characters are a column of their own: inside a lambda they would be split anew for every gram
    chars = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
    at = lambda n: F.when(F.size("gram_chars") >= n, F.sequence(F.lit(1), F.size("gram_chars") - (n - 1))).otherwise(F.array().cast("array<int>"))
    each = [F.transform(at(n), lambda i, n=n: F.array_join(F.slice(F.col("gram_chars"), i, n), "")) for n in LENGTHS]
    return rows.withColumn("gram_chars", chars).withColumn("grams", F.concat(*each)).drop("gram_chars")


def fit_classifier(rows: DataFrame, ridge: float = 1e-3) -> PipelineModel:
    """Fit on ``rows`` (text, label): each class weighs the same, however many rows it has."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("label").alias("classes"))
    weights = counts.crossJoin(F.broadcast(total)).select("label", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))
    ready = with_grams(rows.join(F.broadcast(weights), "label")).select(F.col("label").cast("double").alias("label"), "weight", "grams")
    steps = [HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="tf"), IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="weight", regParam=ridge, maxIter=50)]
    return Pipeline(stages=steps).fit(ready)


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) -> (id, label, probability of that label)."""
    out = model.transform(with_grams(rows.select("id", "text")).select("id", "grams"))
    return out.select("id", F.col("prediction").cast("int").alias("label"), F.array_max(vector_to_array("probability")).alias("probability"))
