"""Balanced contiguous shards by global prefix sums of bytes.

Rows are put in a global order by range partitions. Each partition's rows and
bytes are totalled; the running totals of the partitions before it are where a
partition begins; inside, a running sum in order gives every row's place in the
whole table's bytes. The axis is cut at equal targets, and a row goes to the
shard that its middle byte lies in, so a shard's bytes differ from its target
by less than its first and last row's halves.

What is sent is a row's order, size and checksum, never its text; texts are read
once. The rows' order has their place in the input as its last key, so rows
that are equal in every other key (one id may hold a third of the table) are
spread over partitions as well. The driver gets two numbers a partition and one
a shard. The ranged rows are written to the shared folder before they are
totalled: range borders are sampled anew by each job.

The size of a row is its text's UTF-8 bytes plus 1 (null: 1), so empty rows
weigh too. Null ids come first. Repeated rows take neighbouring places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import cut, fresh, plus, ready


@dataclass(frozen=True)
class Shards:
    shards: int = 8


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _placed(batches: Iterator[pa.RecordBatch], begin: dict[int, tuple[int, int]], cuts: np.ndarray, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number and shard; a partition's batches come in order and carry its number. cuts are doubled bytes, as a middle may lie at a half."""
    part, size, row = names
    at: tuple[int, int] | None = None
    for batch in batches:
        if not len(batch):
            continue
        sizes = batch[size].to_numpy(zero_copy_only=False)
        at = at or begin[batch[part][0].as_py()]
        ends = at[1] + np.cumsum(sizes)
        shard = np.searchsorted(cuts, 2 * ends - sizes, side="right").astype(np.int32)
        columns = {c: batch[c] for c in batch.schema.names}
        yield pa.RecordBatch.from_pydict(columns | {row: pa.array(at[0] + np.arange(len(sizes)), pa.int64()), "_shard": pa.array(shard)})
        at = (at[0] + len(sizes), int(ends[-1]))


def assign(rows: DataFrame, order: list[str], size: str, p: Shards = Shards()) -> DataFrame:
    """rows (small ones: no texts) with _shard and _slot, a row's place in its shard; columns of those names are replaced. size is a column of positive whole numbers. Ties of order go by all other columns that can be compared, then by their place in the input."""
    spark = ready(rows.sparkSession, 10_000)
    rows = rows.drop("_shard", "_slot")
    own = rows.columns
    tie, part, row = (fresh(rows, x) for x in ("_tie", "_part", "_row"))
    first = cut(rows.withColumn(tie, F.monotonically_increasing_id()))
    keys = [*order, *(c for c, t in rows.dtypes if c not in order and not t.startswith("map")), tie]
    ranged = first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    ranged = cut(ranged.withColumn(part, F.spark_partition_id()))
    totals = sorted((r[part], r["rows"], r["bytes"]) for r in ranged.groupBy(part).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).collect())
    before = list(accumulate(totals, lambda a, t: (a[0] + t[1], a[1] + t[2]), initial=(0, 0)))
    begin, whole = {t[0]: b for t, b in zip(totals, before, strict=False)}, before[-1][1]
    names = (part, size, row)
    cuts = np.array([-(-2 * whole * k // p.shards) for k in range(1, p.shards)], np.int64)
    placed = ranged.mapInArrow(lambda it: _placed(it, begin, cuts, names), plus(ranged, f"`{row}` long, _shard int"))
    start = placed.groupBy("_shard").agg(F.min(row).alias("_start")).collect()  # a row a shard
    starts = spark.createDataFrame([(r["_shard"], r["_start"]) for r in start], "_shard int, _start long")
    return placed.join(F.broadcast(starts), "_shard").select(*own, "_shard", (F.col(row) - F.col("_start")).alias("_slot"))


def shard(docs: DataFrame, p: Shards = Shards()) -> DataFrame:
    """doc_id, _size, _crc32 (of the UTF-8 text), _shard and _slot of every row, in doc_id's order."""
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("_size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc32"))
    return assign(rows, ["doc_id"], "_size", p)
