"""Model states as tables: a row for each entry of each tensor, in state order.

A state has rows (owner columns, tensor, name, dtype, shape, trainable, pos,
value, whole). `tensor` numbers the tensors in state order and `pos` a tensor's
entries in row-major order. Entries of floating types are in `value`; those of
other types (counters, flags) are whole numbers in `whole`, so none of them is
rounded. A model's layout has as many rows as it has tensors and is small; its
entries are not, and are only joined, aggregated and mapped.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["tensor", "pos"]
META = ["tensor", "name", "dtype", "shape", "trainable"]


@dataclass(frozen=True)
class Tensor:
    name: str
    shape: tuple[int, ...]
    dtype: str = "float32"
    trainable: bool = True


def is_float(dtype: str | Column = "dtype") -> Column:
    return (F.col(dtype) if isinstance(dtype, str) else dtype).rlike("^(b?float)[0-9]+$")


def layout(spark: SparkSession, tensors: list[Tensor]) -> DataFrame:
    """(tensor, name, dtype, shape, trainable, size, start): start is where a tensor begins in the flattened state. Buffers aren't trainable."""
    rows, at = [], 0
    for i, t in enumerate(tensors):
        rows.append((i, t.name, t.dtype, list(t.shape), t.trainable and t.dtype.startswith(("float", "bfloat")), prod(t.shape), at))
        at += prod(t.shape)
    return spark.createDataFrame(rows, "tensor int, name string, dtype string, shape array<int>, trainable boolean, size long, start long")


def trainable_indices(meta: DataFrame) -> DataFrame:
    """One row: the trainable tensors' numbers in state order."""
    return meta.agg(F.array_sort(F.collect_list(F.when(F.col("trainable"), F.col("tensor")))).alias("indices"))


def last_layer_indices(meta: DataFrame, head: str = "classifier") -> DataFrame:
    """One row: the trainable tensors of the last numbered layer of the head, in state order; buffers and frozen ones are left out."""
    at = F.regexp_extract("name", rf"^{head}\.(\d+)\.", 1)
    m = meta.select("tensor", "trainable", F.when(at != "", at.cast("int")).alias("layer"))
    last = m.agg(F.max("layer").alias("last"))
    return m.crossJoin(F.broadcast(last)).agg(F.array_sort(F.collect_list(F.when(F.col("trainable") & (F.col("layer") == F.col("last")), F.col("tensor")))).alias("indices"))


def from_flat(df: DataFrame, owner: list[str], vector: str, meta: DataFrame) -> DataFrame:
    """States from one flattened array a row; an error where its length isn't the layout's. Entries of other than floating types are cut to whole numbers."""
    size = meta.agg(F.sum("size")).first()[0] or 0
    ok = F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.lit(f"a state has {size} entries")).cast("array<double>"))
    flat = df.select(*owner, F.posexplode(ok.cast("array<double>")).alias("_at", "_v"))
    inside = (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + F.col("size"))
    out = flat.join(F.broadcast(meta), inside)
    return out.select(*owner, *META, (F.col("_at") - F.col("start")).cast("long").alias("pos"), F.when(is_float(), F.col("_v")).alias("value"), F.when(~is_float(), F.col("_v").cast("long")).alias("whole"))


def weights(state: DataFrame, owner: list[str]) -> DataFrame:
    """What is sent: for each owner and tensor its entries as an array in order, tensors by number; an array of the other kind is empty."""
    # a null has no place in collect_list, so each kind keeps its own entries
    entries = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c])
    return state.groupBy(*owner, *META).agg(entries("value").alias("values"), entries("whole").alias("wholes")).orderBy(*owner, "tensor")


def with_weights(meta: DataFrame, sent: DataFrame, owner: list[str]) -> DataFrame:
    """The state that sent weights make, strictly: an error for a tensor too many or too few, or of another number of entries than the layout's."""
    s = sent.select(*owner, "tensor", "values", "wholes")
    owners = s.select(*owner).distinct()
    both = owners.crossJoin(F.broadcast(meta)).join(s, [*owner, "tensor"], "full")
    found = F.size("values") + F.size("wholes")
    said = F.when(F.col("name").isNull(), F.concat(F.lit("unexpected tensor "), F.col("tensor").cast("string"))).when(F.col("values").isNull(), F.concat(F.lit("missing tensor "), F.col("name"))).when(found != F.col("size"), F.concat(F.lit("another shape: "), F.col("name")))
    entries = F.when(said.isNull(), F.arrays_zip("values", "wholes")).otherwise(F.raise_error(said))  # the shorter array is filled with nulls
    rows = both.select(*owner, *META, F.posexplode(entries).alias("pos", "_e"))
    return rows.select(*owner, *META, F.col("pos").cast("long").alias("pos"), F.col("_e.values").alias("value"), F.col("_e.wholes").alias("whole"))


def stored(value: Column, dtype: str | Column = "dtype") -> Column:
    """A double as the type holds it: single precision for 32 bits."""
    kind = F.col(dtype) if isinstance(dtype, str) else dtype
    return F.when(kind == "float32", value.cast("float").cast("double")).otherwise(value)


def _beside(local: DataFrame, base: DataFrame) -> DataFrame:
    """local with the base's entries as g and whole_g; an error where one has an entry that the other lacks, or another shape."""
    g = base.select(*KEYS, F.col("shape").alias("_shape"), F.col("value").alias("g"), F.col("whole").alias("whole_g"))
    out = local.join(g, KEYS, "left")
    bad = F.when(F.col("_shape").isNull() | (F.col("_shape") != F.col("shape")), F.raise_error(F.concat(F.lit("parameter shapes differ: "), "name")).cast("double"))
    return out.withColumn("g", F.coalesce(bad, "g")).drop("_shape")


def scaled(local: DataFrame, base: DataFrame, scale: float, active: Column | None = None) -> DataFrame:
    """local with sent and g: sent = g + scale (local - g) in the tensor's own type where active (else local), whole entries as they are. A sent entry that isn't finite is an error."""
    s = F.when(F.lit(True) if active is None else active, F.lit(float(scale))).otherwise(F.lit(1.0))
    sent = F.col("g") + s * (F.col("value") - F.col("g"))
    out = _beside(local, base).withColumn("_sent", sent)
    finite = F.when(F.col("_sent").isNull() | (~F.isnan("_sent") & (F.abs("_sent") < float("inf"))), stored(F.col("_sent"))).otherwise(F.raise_error(F.lit("an update has NaN or infinity")).cast("double"))
    return out.withColumn("sent", finite).drop("_sent")


def norms(sent: DataFrame, owner: list[str]) -> DataFrame:
    """An owner's clean and sent update norms over all floating tensors; what is compared is the update before it is stored."""
    norm = lambda c: F.sqrt(F.sum((F.col(c) - F.col("g")) * (F.col(c) - F.col("g"))))
    return sent.filter(is_float()).groupBy(*owner).agg(norm("value").alias("clean_l2"), norm("sent").alias("sent_l2"))


def changed(local: DataFrame, base: DataFrame, owner: list[str], least: float = 1e-8) -> DataFrame:
    """The floating tensors that some owner's update moves by more than the least norm: (tensor, name, l2), l2 the largest."""
    d = _beside(local, base).filter(is_float())
    each = d.groupBy(*owner, "tensor", "name").agg(F.sqrt(F.sum((F.col("value") - F.col("g")) * (F.col("value") - F.col("g")))).alias("l2"))
    return each.groupBy("tensor", "name").agg(F.max("l2").alias("l2")).filter(F.col("l2") > least)


def clipped(local: DataFrame, base: DataFrame, owner: list[str], indices: list[int], bound: float) -> DataFrame:
    """The chosen tensors' updates shrunk together to the bound of their joint norm; other tensors stay as sent. Without chosen tensors nothing is sent but the base."""
    d = _beside(local, base)
    if not indices:
        return d.withColumn("value", F.when(is_float(), F.col("g"))).withColumn("whole", F.col("whole_g")).drop("g", "whole_g")
    mine = F.col("tensor").isin(indices) & is_float()
    norm = d.filter(mine).groupBy(*owner).agg(F.sqrt(F.sum((F.col("value") - F.col("g")) * (F.col("value") - F.col("g")))).alias("norm"))
    factor = F.when(F.col("norm") > bound, F.lit(float(bound)) / F.col("norm")).otherwise(1.0)
    moved = stored(F.col("g") + (F.col("value") - F.col("g")) * factor)
    return d.join(F.broadcast(norm), owner, "left").withColumn("value", F.when(mine, moved).otherwise(F.col("value"))).drop("g", "whole_g", "norm")


def noised(state: DataFrame, indices: list[int], stdv: float, seed: int) -> DataFrame:
    """Gaussian noise on the chosen tensors alone; an entry's draw follows from the seed, its tensor and its place, so a task that runs again draws the same."""
    u = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), *KEYS).bitwiseAND(F.lit(2**52 - 1)) + 0.5) / 2.0**52
    draw = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return state.withColumn("value", F.when(F.col("tensor").isin(indices) & is_float(), stored(F.col("value") + stdv * draw)).otherwise(F.col("value")))


def fedavg(sent: DataFrame, owner: str, samples: DataFrame, value: str = "value") -> DataFrame:
    """The mean state, weighted by samples (owner, n); whole entries are weighted as well and cut, as the original's arrays are when they are put back."""
    j = sent.join(F.broadcast(samples.select(owner, "n")), owner)
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return j.groupBy(*META, "pos").agg(mean(value).alias("value"), mean("whole").cast("long").alias("whole")).withColumn("value", stored(F.col("value")))
