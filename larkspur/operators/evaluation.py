"""Confusion matrices and metrics in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.scalars import share


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(c: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class that is a target or a prediction; empty denominators give 0."""
    rows = c.groupBy(F.col("target").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    m = rows.join(cols, "class", "full").fillna(0, ["support", "tp", "said"])
    m = m.withColumn("precision", share(F.col("tp"), F.col("said"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return m.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "support", "tp", "precision", "recall", "f1")


def metrics(c: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 over all; the others over classes with support."""
    m = class_metrics(c)
    r = F.when(F.col("support") > 0, F.col("recall"))
    return m.agg(
        share(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(r).alias("balanced_accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"),
        share(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.min(r).alias("worst_recall"), F.percentile(r, F.lit(0.1)).alias("p10_recall"),
    )


def confusion_rates(c: DataFrame) -> DataFrame:
    total = c.groupBy("target").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    out = c.join(total, "target").filter("target <> predicted")
    return out.select("target", "predicted", "n", share(F.col("n"), F.col("support")).alias("rate"), (F.col("n") / F.nullif((F.col("support") - F.col("right")).cast("double"), F.lit(0.0))).alias("share_of_errors"))


def class_support(counts: DataFrame, by: str, n: str) -> DataFrame:
    """Of zero-filled class counts: the least and the largest, and the entropy over the logarithm of how many classes there are, empty ones included."""
    p = share(F.col(n), F.sum(n).over(W.partitionBy(by)))
    e = F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(0.0))
    return counts.withColumn("_p", p).groupBy(by).agg(F.min(n).alias("least"), F.max(n).alias("most"), share(e, F.ln(F.count("*"))).alias("normalized_entropy"))


def validation_totals(df: DataFrame) -> DataFrame:
    """Of rows client, class_name, correct, total: each class's sums and accuracy, and the accuracy over all. No row at all when any client lacks a number."""
    lacks = F.sum((F.col("correct").isNull() | F.col("total").isNull() | F.col("class_name").isNull()).cast("long"))
    each = df.groupBy("class_name").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), lacks.alias("lacks"))
    whole = each.agg(F.sum("correct").alias("c"), F.sum("total").alias("t"), F.sum("lacks").alias("l"))
    return each.crossJoin(F.broadcast(whole)).filter("l = 0").select("class_name", "correct", "total", share(F.col("correct"), F.col("total")).alias("class_accuracy"), share(F.col("c"), F.col("t")).alias("accuracy"))
