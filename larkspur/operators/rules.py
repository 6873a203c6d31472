"""Many guards in one pass: what breaks a rule becomes a row of a table of violations.

A row rule is a condition that a broken row meets. A key rule says that all rows
of a key share one fact (a group has one class), or that a key occurs once. All
row rules are one explode and all key rules another; one aggregation each, with
partial sums, counts what broke which rule, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "rule string, broken long, example string"


@dataclass(frozen=True)
class Row:
    """Rows that meet the condition break the rule; a null condition doesn't."""

    name: str
    broken: Column
    example: Column


@dataclass(frozen=True)
class Key:
    """Rows of a key must share the fact (nulls are a fact too), or be one where there is no fact; a null key is no key."""

    name: str
    key: Column
    fact: Column | None = None


def violations(df: DataFrame, rules: list[Row | Key]) -> DataFrame:
    """(rule, broken, example): how many rows or keys break a rule and the least of them; a rule that holds has no row."""
    out = df.sparkSession.createDataFrame([], SCHEMA)
    if rows := [r for r in rules if isinstance(r, Row)]:
        said = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.example.cast("string").alias("example"))) for r in rows]))
        out = out.unionByName(df.select(F.explode(said).alias("x")).select("x.*").groupBy("rule").agg(F.count("*").alias("broken"), F.min("example").alias("example")))
    if keys := [r for r in rules if isinstance(r, Key)]:
        facts = F.array(*[F.struct(F.lit(r.name).alias("rule"), r.key.cast("string").alias("key"), (F.coalesce(r.fact.cast("string"), F.lit("\0null")) if r.fact is not None else F.lit(None).cast("string")).alias("fact")) for r in keys])
        each = df.select(F.explode(facts).alias("x")).select("x.*").filter("key IS NOT NULL").groupBy("rule", "key").agg(F.min("fact").alias("a"), F.max("fact").alias("b"), F.count("*").alias("n"))
        bad = (F.col("a") != F.col("b")) | (F.col("a").isNull() & (F.col("n") > 1))
        out = out.unionByName(each.filter(bad).groupBy("rule").agg(F.count("*").alias("broken"), F.min("key").alias("example")))
    return out


def require(found: DataFrame) -> None:
    """A ValueError that names every broken rule, if any."""
    if rows := found.orderBy("rule").limit(100).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['broken']} ({r['example']})" for r in rows))


def grid(spark, **settings: list) -> DataFrame:
    """Every combination of the settings' values: as many rows as the product of their numbers."""
    out = None
    for name, values in settings.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'double' if isinstance(values[0], float) else 'long'}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def holes(cells: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The cells without a value."""
    return cells.join(values.select(*keys), keys, "left_anti")


def complete(cells: DataFrame, values: DataFrame, keys: list[str], what: str = "a value") -> DataFrame:
    """The cells with their values' columns; a cell that lacks one is an error that names it, and so is a cell with two."""
    found = values.withColumn("_n", F.lit(1))
    j = cells.join(found, keys, "left")
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    once = cells.join(values.groupBy(*keys).agg(F.count("*").alias("_copies")).filter("_copies > 1"), keys, "left_semi").select(*keys)
    twice = j.join(once.withColumn("_twice", F.lit(True)), keys, "left")
    bad = F.when(F.col("_n").isNull(), F.concat(F.lit(f"no {what} of "), name)).when(F.col("_twice"), F.concat(F.lit(f"several of {what} of "), name))
    checked = {c: F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col(c)) for c in values.columns if c not in keys}  # in what callers go on to read
    return twice.withColumns(checked).drop("_n", "_twice")
