"""Reads of image folders and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import rules

SAMPLE = "path string, raw_class string, class_name string, size_bytes bigint, sha256 string, leaf_id string, group_id string, group_source string, split string"
ATTACK = "seed int, active_rounds struct<start:int,end:int>, label_flip struct<source_class:string,target_class:string,fraction:double>, model_update struct<mode:string,scale:double>, description string"


def images(spark: SparkSession, root: str, recursive: bool = False, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Image files with their class folder, size and content hash. Content stays with its row."""
    glob = "*.{" + ",".join(f"{e},{e.upper()}" for e in extensions) + "}"
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root}/*")
    return df.select(F.col("path"), F.element_at(F.split("path", "/"), -2).alias("raw_class"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def classes(images_: DataFrame) -> DataFrame:
    return images_.filter(~F.startswith("raw_class", F.lit("."))).select("raw_class").distinct().orderBy("raw_class")


def documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def attack_config(spark: SparkSession, path: str) -> DataFrame:
    """Strict: unknown keys, ranges, equal source and target, or no attack at all raise."""
    raw = spark.read.text(path, wholetext=True)
    known = ["active_rounds", "description", "label_flip", "model_update", "seed"]
    if not raw.filter(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))) > 0).isEmpty():
        raise ValueError("unknown keys")
    df = documents(spark, path, ATTACK)
    flip, update = F.col("label_flip"), F.col("model_update")
    bad = (flip.isNull() & update.isNull()) | ((flip["fraction"] <= 0) | (flip["fraction"] > 1) | (flip["source_class"] == flip["target_class"])) | (F.col("active_rounds.start") < 1) | (F.col("active_rounds.end") < F.col("active_rounds.start")) | F.isnan(update["scale"])
    if not df.filter(F.coalesce(bad, F.lit(False))).isEmpty():
        raise ValueError("not a valid attack")
    return df


def layout(spark: SparkSession, root: str) -> str:
    """pre-split when the folder has both train and val, else flat."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    both = all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, x)) for x in ("train", "val"))
    return "pre-split" if both else "flat"


def attacker_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map pair -> alpha -> seed -> client as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,map<string,int>>>", {"mode": "FAILFAST"}).alias("m"))
    pairs = raw.select(F.explode("m").alias("pair", "m")).select("pair", F.explode("m").alias("alpha", "m"))
    return pairs.select("pair", "alpha", F.explode("m").alias("seed", "client")).select("pair", "alpha", F.col("seed").cast("int").alias("seed"), "client")


def index_list(df: DataFrame, column: str) -> list[int]:
    """The list of indices that every row reports as JSON; a missing, empty or differing one raises."""
    found = df.select(F.from_json(column, "array<int>").alias("x")).distinct().limit(2).collect()
    if len(found) != 1 or not found[0]["x"] or None in found[0]["x"]:
        raise ValueError("not the same non-empty list of every client")
    return found[0]["x"]


def _finite(x: F.Column, t: T.DataType) -> F.Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda y: _finite(y, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(x, lambda _, v: _finite(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_finite(x[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return x


def write_report(df: DataFrame, path: str) -> None:
    """JSON rows in which what isn't a finite number is null, at any depth."""
    df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def source_manifest(df: DataFrame) -> DataFrame:
    """Checks of a partition source: train only, one class a group, no path twice; groups sorted by id, members by path."""
    if not df.filter(~F.col("split").eqNullSafe("train")).isEmpty():
        raise ValueError("only the train split can be partitioned")
    if not df.groupBy("group_id").agg(F.min("class_name").alias("a"), F.max("class_name").alias("b")).filter("a <> b").isEmpty():
        raise ValueError("a group spans classes")
    if not df.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("a path appears twice")
    return df.orderBy("group_id", "path")


def disjoint(train: DataFrame, validation: DataFrame) -> None:
    if not train.join(validation, "path", "left_semi").isEmpty():
        raise ValueError("train and validation share paths")


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_clients(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("client").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Weights (round, tensor, pos, w), a partition a round; the latest is the greatest round."""
    df.write.mode("append").partitionBy("round").parquet(path)


def latest_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.join(F.broadcast(df.agg(F.max("round").alias("round"))), "round")


def ordered_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The latest round's entries in state order: tensors by number (the 10th after the 9th, not after the 1st), entries by place."""
    return latest_checkpoint(spark, path).orderBy("tensor", "pos")


def named_arrays(df: DataFrame, name: str = "name") -> DataFrame:
    """Arrays that a checkpoint keeps as arr_0, arr_1, ...: with tensor, the number in the name, in its order; an error for another name."""
    number = F.regexp_extract(name, "^[A-Za-z]+_([0-9]+)$", 1)
    return df.withColumn("tensor", F.when(number != "", number).otherwise(F.raise_error(F.concat(F.lit("not a checkpoint's array: "), F.col(name)))).cast("int")).orderBy("tensor")


#: A split's manifest: its records, and its samples as [path, label].
SPLIT_DOCUMENT = f"split string, dataset_id string, source_dataset_id string, classes array<string>, source struct<raw_root:string>, records array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in SAMPLE.split(', ')))}>>, samples array<array<string>>"


def split_document(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest under path, and its file's name."""
    return documents(spark, path, SPLIT_DOCUMENT).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)[.]json$", 1))


def split_rows(docs: DataFrame) -> DataFrame:
    """The records of manifests, each with what its manifest says of all; a manifest without records has one row of nulls."""
    r = docs.select("file", F.col("split").alias("said"), "dataset_id", "source.raw_root", "classes", F.size(F.coalesce("samples", F.array().cast("array<array<string>>"))).alias("n_samples"), F.size(F.coalesce("records", F.array())).alias("n_records"), F.posexplode_outer("records").alias("at", "record"))
    return r.withColumn("at", F.coalesce("at", F.lit(0)))


def split_violations(docs: DataFrame) -> DataFrame:
    """What breaks the rules of split manifests: each is of the split that its file names, all have one dataset and one raw_root, classes are known, groups stay in one class and one split, no path occurs twice, and there are as many samples as records."""
    r = split_rows(docs)
    path, record, head = F.col("record.path"), F.col("record"), F.col("at") == 0
    return rules.violations(r, [
        rules.Row("a manifest of another split than its file's", head & ~F.col("said").eqNullSafe(F.col("file")), F.col("file")),
        rules.Row("a record of another split", record.isNotNull() & ~F.col("record.split").eqNullSafe(F.col("file")), path),
        rules.Row("unknown class", record.isNotNull() & ~F.coalesce(F.array_contains("classes", F.col("record.class_name")), F.lit(False)), path),
        rules.Row("records and samples differ in number", head & (F.col("n_samples") != F.col("n_records")), F.col("file")),
        rules.Key("several dataset ids", F.lit("all"), F.col("dataset_id")), rules.Key("several raw_roots", F.lit("all"), F.col("raw_root")),
        rules.Key("a group spans classes", F.col("record.group_id"), F.col("record.class_name")), rules.Key("a group spans splits", F.col("record.group_id"), F.col("file")), rules.Key("a path occurs twice", path),
    ])


def three_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The records of train.json, validation.json and test.json; a ValueError names every rule that they break."""
    docs = split_document(spark, f"{folder}/{{{','.join(('train', 'validation', 'test'))}}}.json")
    rules.require(split_violations(docs))
    return docs.select("dataset_id", "source.raw_root", F.explode("records").alias("r")).select("dataset_id", "raw_root", "r.*")


def partition_source(spark: SparkSession, path: str) -> DataFrame:
    """The records of one manifest that clients may share: the train split by the rules of split_violations; groups by id, members by path."""
    docs = split_document(spark, path).withColumn("file", F.lit("train"))
    rules.require(split_violations(docs))
    return docs.select(F.explode("records").alias("r")).select("r.*").orderBy("group_id", "path")


def samples(docs: DataFrame, root: str) -> DataFrame:
    """(path, label): a manifest's samples under a data root."""
    return docs.select(F.explode("samples").alias("s")).select(F.concat(F.lit(root.rstrip("/") + "/"), F.col("s")[0]).alias("path"), F.col("s")[1].cast("int").alias("label"))


def pair_violations(partition: DataFrame, evaluation: DataFrame) -> DataFrame:
    """What forbids a partition's manifest and an evaluation's to go together; a partition's dataset is its source_dataset_id, or dataset_id without one. The paths that both have are joined, whatever their number."""
    own = partition.select(F.col("classes").alias("a"), F.coalesce("source_dataset_id", "dataset_id").alias("i"))
    both = own.crossJoin(evaluation.select("split", F.col("classes").alias("b"), F.col("dataset_id").alias("j")))  # one row each
    found = rules.violations(both, [
        rules.Row("evaluation is not of the validation split", ~F.col("split").eqNullSafe("validation"), F.col("split")),
        rules.Row("different class orders", ~F.col("a").eqNullSafe(F.col("b")), F.array_join("b", ",")),
        rules.Row("different dataset ids", ~F.col("i").eqNullSafe(F.col("j")), F.col("j")),
    ])
    paths = lambda d: d.select(F.explode("samples").alias("s")).select(F.col("s")[0].alias("path")).distinct()
    return found.unionByName(rules.violations(paths(partition).join(paths(evaluation), "path"), [rules.Row("training and validation share paths", F.lit(True), F.col("path"))]))


def load_violations(docs: DataFrame, classes: int = 2, images_: int = 10) -> DataFrame:
    """What forbids to train from a manifest: too few classes or images."""
    n = F.size(F.coalesce("samples", F.array().cast("array<array<string>>")))
    return rules.violations(docs, [rules.Row(f"fewer than {classes} classes", F.size(F.coalesce("classes", F.array().cast("array<string>"))) < classes, F.col("file")), rules.Row(f"fewer than {images_} images", n < images_, F.col("file"))])
