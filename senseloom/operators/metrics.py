"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("predicted") == F.col("sense")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def per_class_accuracy(predictions: DataFrame) -> DataFrame:
    per = predictions.groupBy("sense").agg(F.avg((F.col("predicted") == F.col("sense")).cast("double")).alias("a"))
    return per.agg(F.avg("a").alias("mean_per_class_accuracy"), F.count("*").alias("n_classes"))


def softmax_loss(scored: DataFrame, key: list[str]) -> DataFrame:
    """Mean cross-entropy over candidates(key, label, logit, sense)."""
    top = scored.groupBy(*key).agg(F.max("logit").alias("m"))
    e = scored.join(top, key).groupBy(*key).agg(F.sum(F.exp(F.col("logit") - F.col("m"))).alias("z"), F.first("m").alias("m"), F.max(F.when(F.col("label") == F.col("sense"), F.col("logit"))).alias("own"))
    return e.agg(F.avg(F.log("z") + F.col("m") - F.col("own")).alias("loss"), F.count("own").alias("n"))


def moving_average(metric: DataFrame, over: int, partition: list[str]) -> DataFrame:
    """average of the last over values by step, and slope: its gain on the step before."""
    w = Window.partitionBy(*partition).orderBy("step")
    avg = F.avg("value").over(w.rowsBetween(-(over - 1), 0))
    return metric.withColumn("average", avg).withColumn("slope", F.col("average") - F.lag("average").over(w))


def number_of_labels(examples: DataFrame) -> DataFrame:
    return examples.agg((F.max("sense") + 1).alias("n_labels"))
