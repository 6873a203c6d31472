"""Round logs as a stream: which runs have evaluated every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "experiment_id string, round int, phase string, num_clients int, num_failures int, ts_utc string"


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def progress(events: DataFrame, rounds: int) -> DataFrame:
    """Per run the good rounds so far, of at most 62; the state is a bit a round, not the rows."""
    if not 0 < rounds <= 62:
        raise ValueError("rounds must be from 1 to 62")
    good = events.filter((F.col("phase") == "evaluate") & (F.col("num_clients") > 0) & (F.col("num_failures") == 0) & F.col("round").between(1, rounds))
    out = good.groupBy("experiment_id").agg(F.bit_or(F.expr("shiftleft(1L, round)")).alias("seen"))
    return out.select("experiment_id", F.bit_count("seen").alias("good_rounds"), (F.bit_count("seen") == rounds).alias("complete"))
