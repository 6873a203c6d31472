"""Strict nested configuration documents, checked by the rules of a schema in one pass over any number of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import rules


@dataclass(frozen=True)
class Value:
    """A number or text in a document: its type, and what stands for it where it is absent or null; without a default it must be there if its object is."""

    type: str
    default: object = None
    required: bool = False


#: What an attack's document may hold, and its defaults.
ATTACK = {
    "seed": Value("int", 1337),
    "description": Value("string"),
    "active_rounds": {"start": Value("int", 1), "end": Value("int")},
    "label_flip": {"source_class": Value("string", required=True), "target_class": Value("string", required=True), "fraction": Value("double", 1.0)},
    "model_update": {"mode": Value("string", "scale_delta"), "scale": Value("double", -5.0)},
}


def _at(path: str) -> Column:
    return F.get_json_object("value", path)


def structure(schema: dict, path: str = "$") -> list[tuple[str, Column]]:
    """What breaks a schema at every depth: not an object, unknown keys, missing keys, values of another type. A null object counts as absent."""
    here = F.col("value") if path == "$" else _at(path)
    keys = F.json_object_keys(here)
    out = [(f"{path} is no object", here.isNotNull() & keys.isNull()), (f"unknown keys in {path}", F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) > 0)]
    for name, kind in schema.items():
        at = f"{path}.{name}"
        if isinstance(kind, dict):
            out += structure(kind, at)
            continue
        found = _at(at)
        if kind.required:
            out.append((f"{at} is missing", keys.isNotNull() & found.isNull()))
        if kind.type == "int":
            number = found.try_cast("double")
            out.append((f"{at} is no whole number", found.isNotNull() & (number.isNull() | F.isnan(number) | (number != F.floor(number)))))
        elif kind.type == "double":
            number = found.try_cast("double")
            out.append((f"{at} is no finite number", found.isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))))
    return out


def values(schema: dict, path: str = "$") -> list[Column]:
    """The document's values, typed, with defaults; an object that is absent is null if it has no default of its own."""
    out = []
    for name, kind in schema.items():
        at = f"{path}.{name}"
        if isinstance(kind, dict):
            whole = F.struct(*values(kind, at))
            out.append((whole if name == "active_rounds" else F.when(_at(at).isNotNull(), whole)).alias(name))
            continue
        found = _at(at).try_cast("double").cast("int") if kind.type == "int" else _at(at).try_cast(kind.type)
        out.append((F.coalesce(found, F.lit(kind.default).cast(kind.type)) if kind.default is not None else found).alias(name))
    return out


def attack_rules() -> list[rules.Row]:
    start, end = F.coalesce(_at("$.active_rounds.start").try_cast("double"), F.lit(1.0)), _at("$.active_rounds.end").try_cast("double")
    fraction = F.coalesce(_at("$.label_flip.fraction").try_cast("double"), F.lit(1.0))
    flip, update = _at("$.label_flip"), _at("$.model_update")
    further = [
        ("the document is no JSON", F.get_json_object("value", "$").isNull()),
        ("active_rounds.start is below 1", start < 1),
        ("active_rounds.end is before the start", end < start),
        ("label_flip has one class for both", _at("$.label_flip.source_class") == _at("$.label_flip.target_class")),
        ("label_flip.fraction is not in (0, 1]", flip.isNotNull() & ((fraction <= 0) | (fraction > 1))),
        ("model_update.mode is not scale_delta", update.isNotNull() & (_at("$.model_update.mode") != "scale_delta")),
        ("there is no attack", flip.isNull() & update.isNull()),
    ]
    return [rules.Row(name, broken, F.col("file")) for name, broken in [*structure(ATTACK), *further]]


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def attack_violations(spark: SparkSession, path: str) -> DataFrame:
    return rules.violations(documents(spark, path), attack_rules())


def attacks(spark: SparkSession, path: str) -> DataFrame:
    """(file, seed, description, active_rounds, label_flip, model_update) of every document under path; a ValueError names every rule that one breaks."""
    docs = documents(spark, path)
    rules.require(rules.violations(docs, attack_rules()))
    return docs.select("file", *values(ATTACK))


def known_classes(attacks_: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that attacks name and classes (class_name) doesn't have: (file, class_name)."""
    named = attacks_.select("file", F.explode(F.array("label_flip.source_class", "label_flip.target_class")).alias("class_name")).filter("class_name IS NOT NULL")
    return named.join(classes.select("class_name"), "class_name", "left_anti").select("file", "class_name")


def settings(raw: DataFrame, defaults: dict[str, object], key: str = "name", value: str = "value") -> dict:
    """Typed settings from rows of names and texts: one that is absent, blank or doesn't parse takes its default. Truth is 1, true, yes or on, in any case; any other text is untrue."""
    given = {r[key]: r[value] for r in raw.filter(F.col(key).isin(list(defaults))).select(key, value).collect()}  # no more rows than defaults, but for repeats
    out = {}
    for name, default in defaults.items():
        text = (given.get(name) or "").strip()
        try:
            out[name] = default if not text else text.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(text)
        except ValueError:
            out[name] = default
    return out
