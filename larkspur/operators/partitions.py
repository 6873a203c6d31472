"""Assignments of samples to clients and how unevenly they own the classes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.scalars import namespaced_key, share

#: Tasks get this module's functions themselves, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def class_client_grid(df: DataFrame, cls: str, client: str, clients: int | None = None) -> DataFrame:
    """Counts of every class and client, zeros included; both dimensions are small by nature and only they are crossed."""
    counts = df.groupBy(F.col(cls).alias("class_name"), F.col(client).alias("client")).agg(F.count("*").alias("n"))
    who = df.sparkSession.range(clients).select(F.col("id").alias("client")) if clients else counts.select("client").distinct()
    grid = counts.select("class_name").distinct().join(who)
    return grid.join(counts, ["class_name", "client"], "left").fillna(0, ["n"])


def heterogeneity(grid: DataFrame) -> DataFrame:
    """Per class: monopoly, entropy, its normalised form, effective clients, owners."""
    w = W.partitionBy("class_name")
    p = grid.withColumn("p", share(F.col("n"), F.sum("n").over(w)))
    out = p.groupBy("class_name").agg(F.sum("n").alias("n"), F.max("p").alias("monopoly"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("h"), F.count("*").alias("k"), F.sum((F.col("n") > 0).cast("int")).alias("clients_with_samples"))
    return out.select("class_name", "n", "monopoly", (F.col("h") + 0.0).alias("entropy"), F.when(F.col("k") > 1, F.col("h") / F.ln("k") + 0.0).otherwise(0.0).alias("normalized_entropy"), F.exp("h").alias("effective_clients"), "clients_with_samples")


def client_totals(grid: DataFrame) -> DataFrame:
    totals = grid.groupBy("client").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("int")).alias("classes"))
    return totals.join(grid.agg(F.sum("n").alias("all"))).select("client", "n", "classes", share(F.col("n"), F.col("all")).alias("share"))


def attackers(grid: DataFrame, source_class: str) -> DataFrame:
    """The client that owns most of a class; ties go to the lowest id."""
    return grid.filter(F.col("class_name") == source_class).agg(F.min_by("client", F.struct(-F.col("n"), "client")).alias("client"), F.max("n").alias("n"))


def hash_ranked(df: DataFrame, by: list[str], key: str, seed: int, namespace: str) -> DataFrame:
    """df with _rn, a row's place within by in hashed order, and _n, the rows of by. Places are counted within 256 hash prefixes and offset by the prefixes before, so no window holds all rows of a class; a null in by is a value like others."""
    k = df.withColumn("_k", namespaced_key(seed, namespace, F.col(key))).withColumn("_b", F.coalesce(F.substring("_k", 1, 2), F.lit("")))
    sizes = k.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_prefix"), before.alias("_before"), F.sum("_m").over(w).alias("_n"))
    on = k["_b"] == F.col("_prefix")
    for i, c in enumerate(by):
        on &= k[c].eqNullSafe(F.col(f"_by{i}"))
    place = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_k", key)) + F.col("_before")
    return k.join(offset, on).withColumn("_rn", place).select(*df.columns, "_rn", "_n")


def round_robin(df: DataFrame, cls: str, key: str, clients: int, seed: int) -> DataFrame:
    return hash_ranked(df, [cls], key, seed, "round-robin").select(*df.columns, ((F.col("_rn") - 1) % clients).cast("int").alias("client"))


def dirichlet_cuts(df: DataFrame, cls: str, key: str, shares: DataFrame, seed: int) -> DataFrame:
    """Images of a class in hashed order, cut at floor(cumulative share x size); shares: (class, client, share)."""
    w = W.partitionBy(cls).orderBy("client")
    cuts = shares.withColumn("hi", F.sum("share").over(w)).withColumn("lo", F.col("hi") - F.col("share"))
    last = F.col("client") == F.max("client").over(W.partitionBy(cls))
    cuts = cuts.withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi")))
    ranked = hash_ranked(df, [cls], key, seed, "dirichlet")
    on = (ranked[cls] == cuts[cls]) & (F.col("_rn") > F.floor(F.col("lo") * F.col("_n") + 1e-9)) & (F.col("_rn") <= F.floor(F.col("hi") * F.col("_n") + 1e-9))
    return ranked.join(F.broadcast(cuts), on).drop(cuts[cls]).drop("_rn", "_n", "lo", "hi", "share")


def dealt(sizes: Sequence[int], takers: int, urgency: Callable[[int, float], object], all_served: bool = False) -> list[int]:
    """Who takes each size in turn: always the most urgent (the least urgency(taker, load so far)), ties to the lowest. With all_served the last sizes go to those that have nothing yet."""
    load = [0.0] * takers
    queue = [(urgency(k, 0.0), k) for k in range(takers)]
    heapify(queue)
    waiting, out = set(range(takers)), []
    for left, n in zip(range(len(sizes), 0, -1), sizes, strict=True):
        if all_served and left <= len(waiting):
            queue = [x for x in queue if x[1] in waiting]
            heapify(queue)
        _, k = queue[0]
        load[k] += n
        waiting.discard(k)
        heapreplace(queue, (urgency(k, load[k]), k))
        out.append(k)
    return out


def _by_class(groups: DataFrame, order: list[F.Column], fn: Callable[[str, list[int]], list[int]]) -> DataFrame:
    """fn over each class's group sizes in order, as taker; only (class, group, size) is gathered, never the samples."""
    columns = ["class_name", "group_id", "n"]
    rank = F.row_number().over(W.partitionBy("class_name").orderBy(*order, "group_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        return pdf[columns].assign(taker=np.array(fn(str(pdf["class_name"].iloc[0]), pdf["n"].tolist()), np.int32))

    return groups.select(*columns, rank.alias("rank")).groupBy("class_name").applyInPandas(run, "class_name string, group_id string, n long, taker int")


def grouped_iid(groups: DataFrame, clients: int, seed: int) -> DataFrame:
    """Whole groups, in hashed order, to the client with the fewest samples of the class so far; ties to the lowest."""
    out = _by_class(groups, [namespaced_key(seed, "iid", F.col("group_id"))], lambda _, sizes: dealt(sizes, clients, lambda k, load: load))
    return out.withColumnRenamed("taker", "client")


def grouped_dirichlet(groups: DataFrame, clients: int, alpha: float, seed: int, least: int = 1, attempts: int = 100) -> DataFrame:
    """Whole groups to the client furthest below its drawn share of the class; ties to the least loaded, then the lowest. All classes are dealt anew until every client has enough samples."""
    groups = groups.persist()

    def drawn(name: str, sizes: list[int], attempt: int) -> list[int]:
        goal = np.random.default_rng([seed, attempt, *name.encode()]).dirichlet([alpha] * clients) * sum(sizes)
        return dealt(sizes, clients, lambda k, load: (load - goal[k], load))

    try:
        for attempt in range(attempts):
            out = _by_class(groups, [namespaced_key(seed, "dirichlet", F.col("group_id"))], lambda name, sizes, a=attempt: drawn(name, sizes, a)).withColumnRenamed("taker", "client")
            loads = {r["client"]: r["n"] for r in out.groupBy("client").agg(F.sum("n").alias("n")).collect()}
            if all(loads.get(k, 0) >= least for k in range(clients)):
                return out
    finally:
        groups.unpersist()
    raise ValueError(f"no partition gives every client {least} samples in {attempts} attempts")


def hash_order_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The first int(n x fraction) rows in hashed order are validation."""
    split = F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(fraction)), "validation").otherwise("train")
    return hash_ranked(df, [], key, seed, "split").select(*df.columns, split.alias("split"))


def per_class_sample(df: DataFrame, cls: str, key: str, k: int, seed: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(cls).orderBy(namespaced_key(seed, "sample", F.col(key)), key))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def label_flip_positions(df: DataFrame, label: str, key: str, source, fraction: float, seed: int) -> DataFrame:
    """max(1, floor(n x fraction)) of the source class's rows in hashed order; smaller fractions are subsets of larger ones."""
    taken = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(fraction))))
    return hash_ranked(df.filter(F.col(label) == source), [label], key, seed, "flip").filter(F.col("_rn") <= taken).select(*df.columns)


def capped_groups(groups: DataFrame, cap: int, seed: int) -> DataFrame:
    """Greedy fill per class: groups by size (largest first), then hashed order; a group that would overflow the cap is skipped. Groups of one size are alike, so the fold runs over a class's distinct sizes only and takes a count of each."""
    sizes = groups.groupBy("class_name", "n").agg(F.count("*").alias("m"))
    runs = sizes.groupBy("class_name").agg(F.sort_array(F.collect_list(F.struct("n", "m")), asc=False).alias("runs"))
    fold = F.expr(f"""aggregate(runs, named_struct('left', cast({cap} AS bigint), 'take', cast(map() AS map<bigint, bigint>)),
        (acc, r) -> named_struct('left', acc.left - r.n * least(r.m, acc.left div r.n),
                                 'take', map_concat(acc.take, map(r.n, least(r.m, acc.left div r.n)))), acc -> acc.take)""")
    take = runs.select("class_name", F.explode(fold).alias("n", "take"))
    rn = F.row_number().over(W.partitionBy("class_name", "n").orderBy(namespaced_key(seed, "cap", F.col("group_id")), "group_id"))
    return groups.join(take, ["class_name", "n"]).withColumn("_rn", rn).filter(F.col("_rn") <= F.col("take")).select("class_name", "group_id", "n")


SPLITS = ("train", "validation", "test")


def split_assignment(groups: DataFrame, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """Groups by size to the split with the largest relative deficit; the last groups are kept for splits without any."""
    if min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be positive and sum to 1")

    def served(_: str, sizes: list[int]) -> list[int]:
        goal = [sum(sizes) * r for r in ratios]
        return dealt(sizes, len(SPLITS), lambda k, load: (load - goal[k]) / max(goal[k], 1.0), all_served=True)

    out = _by_class(groups, [F.desc("n"), namespaced_key(seed, "split", F.col("group_id"))], served)
    return out.select("class_name", "group_id", "n", F.element_at(F.array(*map(F.lit, SPLITS)), F.col("taker") + 1).alias("split"))
