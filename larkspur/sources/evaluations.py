"""Final evaluations of runs: one JSON document each, root/folder/experiment/test_evaluation.json.

They are read by one glob, as many files as there are runs in one job, and a
run's place in the path names it. per_class becomes a row a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import n_correct
from larkspur.operators import rules

FILE = "test_evaluation.json"
STATS = "struct<precision:double,recall:double,f1:double,support:long>"
EVALUATION = f"split string, num_images long, metrics struct<accuracy:double,balanced_accuracy:double,macro_f1:double,loss:double>, per_class map<string,{STATS}>"


def evaluation_path(root: str, folder: str, experiment: str) -> str:
    return f"{root}/{folder}/{experiment}/{FILE}"


def write(df: DataFrame, root: str) -> None:
    """Rows (folder, experiment_id, split, num_images, metrics, per_class) as one document a run. Spark names the files of a run's folder itself; read takes either name."""
    keys = ["folder", "experiment_id"]
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("ignoreNullFields", False).json(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """(folder, experiment_id, split, num_images, metrics, per_class) of every evaluation under root; a document that isn't JSON is an error."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    part = lambda k: F.try_url_decode(F.try_url_decode(F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), k), "^(folder|experiment_id)=", ""), F.lit("+"), F.lit("%2B"))))
    # Spark escapes a value in its folder's name, and that name in the file's URL
    # a folder that Spark wrote may hold several documents, a line each
    docs = raw.select(part(-3).alias("folder"), part(-2).alias("experiment_id"), F.explode(F.when(path.endswith(FILE), F.array("value")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))).alias("value"))
    return docs.select("folder", "experiment_id", F.from_json("value", EVALUATION, {"mode": "FAILFAST"}).alias("e")).select("folder", "experiment_id", "e.*")


def per_class(evaluations: DataFrame) -> DataFrame:
    """A row for each class of each run: recall, support and n_correct, which is the whole number nearest to their product within the support."""
    rows = evaluations.select("folder", "experiment_id", F.explode("per_class").alias("class_name", "s"))
    return rows.select("folder", "experiment_id", "class_name", F.col("s.recall").alias("recall"), F.col("s.support").alias("support"), n_correct(F.col("s.recall"), F.col("s.support")).alias("n_correct"))


def missing(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The runs (folder, experiment_id) that have no evaluation."""
    keys = ["folder", "experiment_id"]
    return runs.select(*keys).distinct().join(evaluations.select(*keys), keys, "left_anti")


def source_recall(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """runs (folder, experiment_id, source_class, ...) with the recall of their source class; a run without it is an error."""
    found = classes.select("folder", "experiment_id", F.col("class_name").alias("source_class"), F.col("recall").alias("source_recall"))
    return rules.complete(runs, found, ["experiment_id", "folder", "source_class"], "recall")


def own_baseline_harm(attacked: DataFrame, clean: DataFrame) -> DataFrame:
    """(alpha, aggregator, harm): each aggregator's loss of source recall against its own clean run of the seed, averaged over seeds within a pair, then over pairs. Both have (alpha, aggregator, seed, source_recall), attacked also pair; clean has source_class, as attacked has, for it is one run for all pairs. An attacked run without its clean one is an error."""
    keys = ["aggregator", "alpha", "seed", "source_class"]
    j = rules.complete(attacked, clean.select(*keys, F.col("source_recall").alias("_clean")), keys, "clean run")
    pairs = j.groupBy("alpha", "aggregator", "pair").agg(F.avg(F.col("_clean") - F.col("source_recall")).alias("m"))
    return pairs.groupBy("alpha", "aggregator").agg(F.avg("m").alias("harm"))
