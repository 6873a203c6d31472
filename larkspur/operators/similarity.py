"""Pairs of 64-bit hashes within a Hamming radius, by bands."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import hamming


def bands(radius: int) -> list[tuple[int, list[int]]]:
    """Disjoint bit fields of a 64-bit hash: each field's mask and the patterns of at most t of its bits, t = 1 (2 from radius 10 on). There are so many fields that two hashes within the radius differ in at most t bits of at least one."""
    t = 1 if radius < 10 else 2
    n = radius // (t + 1) + 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for k in range(n):
        bits = [1 << i for i in range(64 * k // n, 64 * (k + 1) // n)]
        out.append((signed(sum(bits)), [0, *(signed(sum(c)) for size in range(1, t + 1) for c in combinations(bits, size))]))
    return out


def hamming_pairs(df: DataFrame, path: str, cls: str, h: str, radius: int) -> DataFrame:
    """Each unordered pair of a class within the radius once, left_path < right_path. One side is found under its own fields, the other under all near values of its fields; a pair that meets in several fields counts in its first only, so no distinct is needed."""
    fields = bands(radius)
    x = df.select(F.col(path).alias("path"), F.col(cls).alias("class_name"), F.col(h).alias("h"))
    own = F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m, _ in fields])
    near = F.array(*[F.array(*[F.col("h").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(v)) for v in patterns]) for m, patterns in fields])
    a = x.select("*", F.posexplode(near).alias("k", "values")).select("path", "class_name", "h", "k", F.explode("values").alias("band")).alias("a")
    b = x.select("*", F.posexplode(own).alias("k", "band")).alias("b")
    j = a.join(b, (F.col("a.class_name") == F.col("b.class_name")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.path") < F.col("b.path")))
    t, unlike = (1 if radius < 10 else 2), F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.coalesce(*[F.when(F.bit_count(unlike.bitwiseAND(F.lit(m))) <= t, F.lit(k)) for k, (m, _) in enumerate(fields)])
    j = j.withColumn("distance", hamming(F.col("a.h"), F.col("b.h"))).filter((F.col("distance") <= radius) & (first == F.col("a.k")))
    return j.select(F.col("a.class_name").alias("class_name"), F.col("a.path").alias("left_path"), F.col("b.path").alias("right_path"), "distance")


def histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.format_string("p%02d", F.col("distance").cast("int")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """min, p25, median, p75, p95, max with linear interpolation; nulls when empty."""
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    return df.agg(F.min(column).cast("double").alias("min"), q.alias("q"), F.max(column).cast("double").alias("max")).select("min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))], "max")


def sibling_pairs(df: DataFrame, path: str, group: str, h: str) -> DataFrame:
    """All pairs inside a group at any distance (groups are leaves: small by nature)."""
    a, b = df.alias("a"), df.alias("b")
    j = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{path}") < F.col(f"b.{path}")))
    return j.select(F.col(f"a.{path}").alias("left_path"), F.col(f"b.{path}").alias("right_path"), hamming(F.col(f"a.{h}"), F.col(f"b.{h}")).alias("distance"))


def two_hash_histogram(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """How many pairs there are at each pair of distances, keyed pXX_dYY."""
    return pairs.groupBy(F.format_string("p%02d_d%02d", F.col(first).cast("int"), F.col(second).cast("int")).alias("bucket")).agg(F.count("*").alias("n"))


def reported(pairs: DataFrame, most: int, scan: list[str], order: list[str]) -> DataFrame:
    """The report of unresolved candidates: the first so many in scan order, then sorted. Counts are taken from all pairs, elsewhere."""
    return pairs.orderBy(*scan).limit(most).orderBy(*order)
