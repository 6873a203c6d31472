"""What several operators of this subpackage need of Spark."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession, rows: int = 1_000) -> SparkSession:
    """Lets Python workers import this package and bounds the Arrow batches they get."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # many very long texts in a row
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; where that is unset (as in tests on one machine), a folder of the session's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Lets go of finished shuffles: Spark deletes their files when the driver's garbage collector finds that nothing refers to them, which may otherwise be long after. Python's dropped frames reach the JVM within a second or so, and Spark's listeners refer to the last query until another follows, so a tiny one does."""
    gc.collect()
    time.sleep(1.5)
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches; after the last one Arrow's pool gives back what it keeps, since the Python worker stays for later tasks and stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema and more columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) where root is the least node. By alternating large and small stars, each an aggregation that combines before the shuffle and a join that adaptive execution can split, until the edges no longer change."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    e = cut(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut: so both sides of the joins come from exchanges of their own, and adaptive execution can split a star's centre
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
