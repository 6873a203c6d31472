"""Rényi accounting and job registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import RENYI_ORDERS, gaussian_rdp, rdp_to_epsilon


def tightest_epsilon(settings: DataFrame) -> DataFrame:
    """For rows (steps, noise, delta): the least epsilon over the orders, the first order winning ties."""
    x = settings.withColumn("order", F.explode(F.array(*[F.lit(float(o)) for o in RENYI_ORDERS])))
    x = x.withColumn("epsilon", rdp_to_epsilon(gaussian_rdp(F.col("steps"), F.col("order"), F.col("noise")), F.col("order"), F.col("delta")))
    return x.groupBy(*settings.columns).agg(F.min("epsilon").alias("epsilon"), F.min_by("order", F.struct("epsilon", "order")).alias("order"))


def job_matrix(spark: SparkSession, **dimensions: list) -> DataFrame:
    """The cross product of a registry's few settings."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in dimensions.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def completeness(events: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """complete where rounds 1 to rounds were each evaluated by clients without failures."""
    good = events.filter((F.col("num_clients") > 0) & (F.col("num_failures") == 0))
    return events.select(*keys).distinct().join(good.groupBy(*keys).agg(F.count_distinct(F.when(F.col("round").between(1, rounds), F.col("round"))).alias("good_rounds"), F.max("round").alias("last_round")), keys, "left").fillna(0, ["good_rounds"]).withColumn("complete", F.col("good_rounds") == rounds)


def status(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.select(*keys, "complete"), keys, "left").withColumn("status", F.when(F.col("complete").isNull(), "pending").when(F.col("complete"), "complete").otherwise("incomplete")).drop("complete")


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.filter("complete"), keys, "left_anti")


def attack_verified(events: DataFrame, attacker: F.Column, rounds: int | None = None, flipped: bool = False, scale: float | None = None) -> DataFrame:
    """Per run: the attacker is flagged in every fit round, nobody else ever is, and its counts are positive. Rows (run, round, client, flagged, n). With rounds there must be so many; with flipped its column flipped must be positive, with scale its column scale that number within 1e-6."""
    own, right = F.coalesce(attacker, F.lit(False)), F.col("flagged") & (F.col("n") > 0)
    if flipped:
        right = right & (F.coalesce("flipped", F.lit(0)) > 0)
    if scale is not None:
        right = right & F.coalesce(F.abs(F.col("scale") - scale) <= 1e-6, F.lit(False))
    per = events.groupBy("run", "round").agg(F.coalesce(F.bool_and(F.when(own, right)), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.when(~own, F.col("flagged"))), F.lit(False)).alias("others"))
    whole = F.count("*") == rounds if rounds else F.lit(True)
    return per.groupBy("run").agg(F.count("*").alias("rounds"), (F.bool_and("own") & ~F.bool_or("others") & whole).alias("verified"))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: of several the last in order. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def first_known(df: DataFrame, keys: list[str], value: str, sources: dict[str, DataFrame], formula: F.Column) -> DataFrame:
    """df with value and provenance: from the first source (keys, value) that knows the key, else by the formula."""
    found, tag = F.lit(None), F.lit(None)
    out = df
    for name, source in sources.items():
        out = out.join(source.select(*keys, F.col(value).alias(f"_{name}")), keys, "left")
        tag = F.coalesce(tag, F.when(F.col(f"_{name}").isNotNull(), F.lit(name)))
        found = F.coalesce(found, F.col(f"_{name}"))
    return out.select(*df.columns, F.coalesce(found, formula).alias(value), F.coalesce(tag, F.lit("formula")).alias("provenance"))
