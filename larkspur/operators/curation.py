"""Grouping of samples by shared content or leaf, and checks of splits made from them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager=True)


def coverage(df: DataFrame, cls: str, leaf: str) -> DataFrame:
    return df.groupBy(F.col(cls).alias("class_name")).agg(F.count("*").alias("images"), F.count(leaf).alias("mapped")).withColumn("unmapped", F.col("images") - F.col("mapped"))


def eligible(df: DataFrame, cls: str, leaf: str, least: float, require_leaf: bool = True) -> DataFrame:
    """The rows of classes whose coverage reaches the least share, with a leaf."""
    good = coverage(df, cls, leaf).filter(F.col("mapped") / F.greatest("images", F.lit(1)) >= least).select(F.col("class_name").alias(cls))
    out = df.join(good, cls, "left_semi")
    return out.filter(F.col(leaf).isNotNull()) if require_leaf else out


def shared_key_components(df: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Components of nodes that share a value of any key: (node, root). Least labels travel from nodes to keys and back, each an aggregation with partial sums; keys held by one node never travel. The root is the least node."""
    pairs = df.select(F.col(node).alias("node"), F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.sha2(F.col(k).cast("string"), 256))) for i, k in enumerate(keys)])).alias("key")).filter("key IS NOT NULL").distinct()
    often = pairs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    pairs = cut(pairs.join(often, "key"))
    labels = cut(df.select(F.col(node).alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        least = cut(pairs.join(labels, "node").groupBy("key").agg(F.min("root").alias("m")))  # so the next join reads exchanges on both sides and a hot key can be split
        better = pairs.join(least, "key").groupBy("node").agg(F.min("m").alias("m"))
        new = labels.join(better, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        # pointer jumping: a root's own root
        roots = new.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(new.join(roots, "root").select("node", "old", F.col("next").alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def with_group_id(df: DataFrame, node: str, components: DataFrame) -> DataFrame:
    """group_id: pv- and the first 20 digits of the SHA-256 of the component's sorted members, one a line. By that definition a component's member names meet in one task; nothing else of them does."""
    ids = components.groupBy("root").agg(F.concat(F.lit("pv-"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("node")), "\n"), 256), 1, 20)).alias("group_id"), F.count("*").alias("group_size"))
    return df.join(components.withColumnRenamed("node", node), node).join(ids, "root").drop("root")


def group_source(df: DataFrame, group: str, leaf: str, content: str) -> DataFrame:
    """Why a group is one: leaf_id+sha256, leaf_id, sha256 or singleton."""
    facts = df.groupBy(group).agg((F.count(leaf) > 0).alias("has_leaf"), (F.count("*") > F.count_distinct(content)).alias("has_copy"), F.count("*").alias("images"))
    return facts.withColumn("group_source", F.when(F.col("has_leaf") & F.col("has_copy"), "leaf_id+sha256").when(F.col("has_leaf"), "leaf_id").when(F.col("has_copy"), "sha256").otherwise("singleton"))


def duplicate_sets(df: DataFrame, content: str, cls: str) -> DataFrame:
    """One row: sets of equal content, their images, and sets with several classes."""
    sets = df.groupBy(content).agg(F.count("*").alias("n"), F.min(cls).alias("a"), F.max(cls).alias("b")).filter("n > 1")
    return sets.agg(F.count("*").alias("duplicate_sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_images"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("label_conflicts"))


def split_counts(df: DataFrame, cls: str, split: str, splits: tuple[str, ...]) -> DataFrame:
    """Images and groups of every class and split, zeros included."""
    grid = df.select(F.col(cls).alias("class_name")).distinct().crossJoin(df.sparkSession.createDataFrame([(s,) for s in splits], "split string"))
    counts = df.groupBy(F.col(cls).alias("class_name"), F.col(split).alias("split")).agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))
    return grid.join(counts, ["class_name", "split"], "left").fillna(0, ["images", "groups"])


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys in more than one split."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("images")).filter("splits > 1")


def manifest_digest(df: DataFrame) -> DataFrame:
    """The SHA-256 of the records' canonical JSON in path order."""
    row = F.to_json(F.struct("class_name", "group_id", "path", "sha256", "split"))
    return df.agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", row.alias("j")))), lambda x: x["j"]), ","), F.lit("]")), 256).alias("digest"))


def dataset_id(df: DataFrame, variant: str) -> DataFrame:
    """pv, the number of classes, the variant and the first 12 signs of the manifest's digest."""
    classes = df.agg(F.count_distinct("class_name").alias("k"))
    return manifest_digest(df).crossJoin(F.broadcast(classes)).select(F.concat(F.lit("pv"), F.col("k").cast("string"), F.lit(f"-{variant}-"), F.substring("digest", 1, 12)).alias("dataset_id"), "digest")


def grouping_audit(df: DataFrame, leaf: str, content: str, group: str) -> DataFrame:
    """One row of what a selection holds: images, known and unknown leaves, groups, and sets of equal content."""
    whole = df.agg(F.count("*").alias("images"), F.count(leaf).alias("known"), F.count_distinct(leaf).alias("leaves"), F.count_distinct(group).alias("groups")).withColumn("unknown", F.col("images") - F.col("known"))
    sets = df.groupBy(content).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_images"))
    return whole.crossJoin(F.broadcast(sets))


def audit_gate(candidates: DataFrame, structure_valid: bool) -> bool:
    """A dataset may be used only when its structure is valid and no near-duplicate candidate is unresolved."""
    return structure_valid and candidates.isEmpty()


def group_set_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two (class, group, n): per class the groups of each, those missing, extra and changed, and whether all agree."""
    both = a.select("class_name", "group_id", F.col("n").alias("na")).join(b.select("class_name", "group_id", F.col("n").alias("nb")), ["class_name", "group_id"], "full")
    one = lambda c: F.sum(c.cast("long"))
    out = both.groupBy("class_name").agg(one(F.col("na").isNotNull()).alias("left_groups"), one(F.col("nb").isNotNull()).alias("right_groups"), one(F.col("na").isNull()).alias("extra"), one(F.col("nb").isNull()).alias("missing"), F.coalesce(one(F.col("na") != F.col("nb")), F.lit(0)).alias("changed"))
    return out.withColumn("identical", (F.col("extra") == 0) & (F.col("missing") == 0) & (F.col("changed") == 0))


def split_crosstab(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Left join of two split maps: counts by both splits; missing where b lacks the key."""
    j = a.select(key, F.col("split").alias("left_split")).join(b.select(key, F.col("split").alias("right_split")), key, "left")
    return j.groupBy("left_split", F.coalesce("right_split", F.lit("missing")).alias("right_split")).agg(F.count("*").alias("n"))
