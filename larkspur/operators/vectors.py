"""Aggregation of client vectors and transforms of their updates, over rows (client, pos, w[, n])."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def exploded(df: DataFrame, client: str, vector: str) -> DataFrame:
    return df.select(F.col(client).alias("client"), F.posexplode(vector).alias("pos", "w")).withColumn("w", F.col("w").cast("double"))


def fedavg(v: DataFrame) -> DataFrame:
    return v.groupBy("pos").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))


def coordinate_median(v: DataFrame) -> DataFrame:
    return v.groupBy("pos").agg(F.percentile("w", F.lit(0.5)).alias("w"))


def trimmed_mean(v: DataFrame, clients: int, beta: float = 0.25) -> DataFrame:
    drop = math.floor(beta * clients)
    rn = F.row_number().over(W.partitionBy("pos").orderBy("w", "client"))
    return v.withColumn("rn", rn).filter((F.col("rn") > drop) & (F.col("rn") <= clients - drop)).groupBy("pos").agg(F.avg("w").alias("w"))


def krum_scores(v: DataFrame, clients: int, byzantine: int = 1) -> DataFrame:
    """Sums of a client's clients - byzantine - 2 smallest squared distances to others."""
    a, b = v.select("client", "pos", "w"), v.select(F.col("client").alias("other"), "pos", F.col("w").alias("v"))
    d = a.join(b, "pos").filter("client <> other").groupBy("client", "other").agg(F.sum((F.col("w") - F.col("v")) * (F.col("w") - F.col("v"))).alias("d"))
    rn = F.row_number().over(W.partitionBy("client").orderBy("d", "other"))
    return d.withColumn("rn", rn).filter(F.col("rn") <= clients - byzantine - 2).groupBy("client").agg(F.sum("d").alias("score"))


def multikrum(v: DataFrame, clients: int, byzantine: int = 1, keep: int = 4) -> DataFrame:
    best = krum_scores(v, clients, byzantine).orderBy(F.round("score", 9), "client").limit(keep).select("client")
    return fedavg(v.join(best, "client", "left_semi"))


def krum(v: DataFrame, clients: int, byzantine: int = 1) -> DataFrame:
    return multikrum(v, clients, byzantine, 1)


def scaled(v: DataFrame, base: DataFrame, scale: float) -> DataFrame:
    """sent = base + scale (local - base)."""
    return v.join(base.select("pos", F.col("w").alias("g")), "pos").withColumn("sent", F.col("g") + F.lit(float(scale)) * (F.col("w") - F.col("g")))


def delta_norms(s: DataFrame) -> DataFrame:
    norm = lambda c: F.sqrt(F.sum((F.col(c) - F.col("g")) * (F.col(c) - F.col("g"))))
    return s.groupBy("client").agg(norm("w").alias("clean_l2"), norm("sent").alias("sent_l2"))


def clipped(v: DataFrame, base: DataFrame, bound: float) -> DataFrame:
    """The update shrunk to the bound of its L2 norm over all positions."""
    d = v.join(base.select("pos", F.col("w").alias("g")), "pos").withColumn("d", F.col("w") - F.col("g"))
    norms = d.groupBy("client").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    factor = F.when(F.col("norm") > bound, F.lit(float(bound)) / F.col("norm")).otherwise(1.0)
    return d.join(norms, "client").select("client", "pos", (F.col("g") + F.col("d") * factor).alias("w"), "norm")


def noised(agg: DataFrame, stdv: float, seed: int) -> DataFrame:
    return agg.withColumn("w", F.col("w") + F.randn(seed) * stdv) if stdv > 0 else agg


def changed_tensors(v: DataFrame, base: DataFrame, least: float = 1e-8) -> DataFrame:
    """Tensors whose update has, for some client, a norm above the least; rows need a tensor column."""
    d = v.join(base.select("tensor", "pos", F.col("w").alias("g")), ["tensor", "pos"])
    return d.groupBy("tensor", "client").agg(F.sqrt(F.sum(F.pow(F.col("w") - F.col("g"), 2))).alias("l2")).groupBy("tensor").agg(F.max("l2").alias("l2")).filter(F.col("l2") > least)
