"""How a capped selection of a dataset and the whole of it differ, when both were split on their own.

Both sides are records (path, sha256, group_id, leaf_id, class_name, split). The
result is one long table (section, key, name, value); every number comes from
joins on keys and aggregations, whatever the sizes. Records that contradict each
other within a side are an error (protocol.split_maps, protocol.record_maps).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import protocol


def _long(df: DataFrame, section: str, key: Column, **values: Column) -> DataFrame:
    """A row for each value of each row."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in values.items()])
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(pairs).alias("x")).select("section", "key", "x.*")


def construction(side: DataFrame, name: str) -> DataFrame:
    """Images, contents and groups of a side, and the images of each split."""
    whole = side.agg(F.count("*").alias("a"), F.count_distinct("sha256").alias("b"), F.count_distinct("group_id").alias("c"))
    splits = side.groupBy("split").agg(F.count("*").alias("n"))
    return _long(whole, f"construction {name}", F.lit("all"), n_images=F.col("a"), n_unique_sha=F.col("b"), n_groups=F.col("c")).unionByName(_long(splits, f"construction {name}", F.col("split"), n_images=F.col("n")))


def overlap(capped: DataFrame, full: DataFrame) -> DataFrame:
    """For paths, contents, groups and leaves: how many keys of a capped split are in each full split, or in none."""
    a, b = (protocol.split_maps(x).select("kind", "key", "split") for x in (capped, full))
    j = a.join(b.withColumnRenamed("split", "to"), ["kind", "key"], "left").groupBy("kind", "split", "to").agg(F.count("*").alias("n"))
    return j.select(F.concat(F.lit("overlap "), "kind").alias("section"), F.col("split").alias("key"), F.coalesce("to", F.lit("absent")).alias("name"), F.col("n").cast("double").alias("value"))


def _groups(side: DataFrame) -> DataFrame:
    return side.groupBy("class_name", "group_id").agg(F.min("split").alias("split"), F.count("*").alias("n"))


def group_sets(capped: DataFrame, full: DataFrame) -> DataFrame:
    """By class: groups of each side, those of one side only, shared ones whose split differs and their capped images, and whether the sets are the same."""
    j = _groups(capped).alias("a").join(_groups(full).alias("b"), ["class_name", "group_id"], "full")
    own, other = F.col("a.split"), F.col("b.split")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    each = j.groupBy("class_name").agg(
        count(own.isNotNull()).alias("capped"), count(other.isNotNull()).alias("full"), count(own.isNull()).alias("extra"), count(other.isNull()).alias("missing"),
        count(own != other).alias("changed"), F.sum(F.when(own != other, F.col("a.n")).otherwise(0)).alias("images"),
    )
    same = (F.col("extra") == 0) & (F.col("missing") == 0)
    return _long(each.filter("capped > 0"), "groups", F.col("class_name"), capped_groups=F.col("capped"), full_groups=F.col("full"), n_extra_full_groups=F.col("extra"), n_capped_missing_in_full=F.col("missing"), n_shared_groups_changed_split=F.col("changed"), n_capped_images_in_changed_groups=F.col("images"), identical_group_set=same.cast("int"))


def class_paths(capped: DataFrame, full: DataFrame) -> DataFrame:
    """By class and split: the paths of each side and those that both have in that split."""
    keys = ["class_name", "split", "path"]
    j = capped.select(*keys).distinct().withColumn("a", F.lit(1)).join(full.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    each = j.groupBy("class_name", "split").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.col("a") + F.col("b")).alias("both"))
    return _long(each, "paths", F.concat_ws("/", "class_name", "split"), capped=F.col("a"), full=F.col("b"), intersection=F.col("both"))


def test_support(side: DataFrame, name: str) -> DataFrame:
    """Least and largest support of a class in the test split, the shares' entropy over all classes there, and each class's support and share."""
    each = side.filter("split = 'test'").groupBy("class_name").agg(F.count("*").alias("n"))
    whole = each.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nln"), F.count("*").alias("k"))
    entropy = F.when(F.col("k") > 1, (F.log("all") - F.col("nln") / F.col("all")) / F.log("k"))
    shares = each.crossJoin(F.broadcast(whole.select("all")))
    return _long(whole, f"test support {name}", F.lit("all"), least=F.col("least"), most=F.col("most"), entropy_norm=entropy).unionByName(_long(shares, f"test support {name}", F.col("class_name"), support=F.col("n"), share=F.col("n") / F.col("all")))


def scale_extension(capped: DataFrame, full: DataFrame) -> DataFrame:
    """All of these; a group of several classes on a side is an error."""
    checked = [protocol.record_maps(x).filter("kind = 'group_class'").agg(F.count("value").alias("n")) for x in (capped, full)]
    guards = [_long(g, f"construction {name}", F.lit("all"), n_groups_with_class=F.col("n")) for g, name in zip(checked, ("capped", "full"), strict=True)]
    parts = [construction(capped, "capped"), construction(full, "full"), overlap(capped, full), group_sets(capped, full), class_paths(capped, full), test_support(capped, "capped"), test_support(full, "full"), *guards]
    return reduce(DataFrame.unionByName, parts)
