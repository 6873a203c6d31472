"""How classes, leaves, splits and settings are resolved and checked before a dataset is used."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import active, finite


def failing(bad: F.Column, message: F.Column, value: F.Column) -> F.Column:
    """value, or an error with the message where bad holds."""
    return F.when(bad, F.raise_error(message).cast("string")).otherwise(value)


def source_names(renames: Mapping[str, str], aliases: Mapping[str, list[str]], wanted: Iterable[str] | None = None) -> dict[str, list[str]]:
    """For each canonical class the folder names it may have: those of the rename map, or the aliases where there are any. Unknown wanted classes are an error."""
    names: dict[str, list[str]] = {}
    for raw, canonical in renames.items():
        names.setdefault(canonical, []).append(raw)
    names |= {k: list(v) for k, v in aliases.items()}
    chosen = set(names) if wanted is None else set(wanted)
    if unknown := sorted(chosen - set(names)):
        raise ValueError(f"unknown classes: {unknown}")
    return {k: names[k] for k in sorted(chosen)}


def resolved_classes(candidates: DataFrame, folders: DataFrame) -> DataFrame:
    """Of candidates (class_name, folder) and the folders there are: (class_name, folder, state), one row a class; state is found, missing or several (folder is null unless found)."""
    there = candidates.join(folders.select("folder", F.lit(1).alias("_there")).distinct(), "folder", "left")
    out = there.groupBy("class_name").agg(F.count("_there").alias("n"), F.min(F.when(F.col("_there") == 1, F.col("folder"))).alias("folder"))
    return out.select("class_name", F.when(F.col("n") == 1, F.col("folder")).alias("folder"), F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("several").alias("state"))


def unknown_classes(names: DataFrame, known: DataFrame, column: str = "class_name") -> DataFrame:
    """The names that known lacks, once each; nulls are not names."""
    return names.select(column).filter(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")


def with_leaf(records: DataFrame, stem: str, cls: str, leaves: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """records with leaf_id: the leaf of the same stem whose name begins with the record's class, or another prefix of that class, and `:::`. None is null, several are an error. leaves: (stem, leaf); prefixes: (class_name, prefix)."""
    found = leaves.select(F.col("stem").alias("_stem"), "leaf", F.substring_index("leaf", ":::", 1).alias("_prefix")).filter(F.contains("leaf", F.lit(":::")))
    own = found.select("_stem", "leaf", F.col("_prefix").alias("_class"))
    if prefixes is not None:
        own = own.unionByName(found.join(prefixes.select(F.col("prefix").alias("_prefix"), F.col("class_name").alias("_class")).distinct(), "_prefix").select("_stem", "leaf", "_class"))
    each = own.groupBy("_stem", "_class").agg(F.min("leaf").alias("_leaf"), F.count("*").alias("_n"))
    j = records.join(each, (records[stem] == each["_stem"]) & (records[cls] == each["_class"]), "left")
    return j.select(*[records[c] for c in records.columns], failing(F.col("_n") > 1, F.concat(F.lit("several leaves of "), F.col("_stem")), F.col("_leaf")).alias("leaf_id"))


def split_maps(records: DataFrame) -> DataFrame:
    """The split of every path, content, group and leaf: rows (kind, key, split, images). A path that occurs twice, or a content, group or leaf in several splits, is an error. Columns path, sha256, group_id, leaf_id, split; a null key is no key."""
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in (("path", "path"), ("sha", "sha256"), ("group", "group_id"), ("leaf", "leaf_id"))])
    rows = records.select("split", F.explode(keys).alias("x")).select("split", "x.*").filter("key IS NOT NULL")
    each = rows.groupBy("kind", "key").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("images"))
    bad = (F.col("a") != F.col("b")) | ((F.col("kind") == "path") & (F.col("images") > 1))
    return each.select("kind", "key", failing(bad, F.concat(F.lit("conflict of "), F.col("kind"), F.lit(" "), F.col("key")), F.col("a")).alias("split"), "images")


def map_sizes(maps: DataFrame) -> DataFrame:
    """How many keys of each kind every split has."""
    return maps.groupBy("kind", "split").agg(F.count("*").alias("keys"), F.sum("images").alias("images"))


def record_maps(records: DataFrame) -> DataFrame:
    """What records say of each other: rows (kind, key, value) of group to class, path to group and path to class. A group of several classes, or a path of several groups, is an error. Columns path, group_id, class_name; a null key is no key."""
    pairs = (("group_class", "group_id", "class_name"), ("path_group", "path", "group_id"), ("path_class", "path", "class_name"))
    rows = records.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value")) for kind, k, v in pairs])).alias("x")).select("x.*").filter("key IS NOT NULL")
    each = rows.groupBy("kind", "key").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return each.select("kind", "key", failing(F.col("a") != F.col("b"), F.concat(F.lit("several values of "), F.col("kind"), F.lit(" "), F.col("key")), F.col("a")).alias("value"))


def class_counts(records: DataFrame) -> DataFrame:
    """Images and groups of each class in each split."""
    return records.groupBy("split", "class_name", "group_id").agg(F.count("*").alias("n")).groupBy("split", "class_name").agg(F.sum("n").alias("images"), F.count("group_id").alias("groups"))


def looked_up(rows: DataFrame, index: str, names: DataFrame, name: str = "class_name") -> DataFrame:
    """rows with the name of their index, from names (index, name); an index without a name is an error."""
    j = rows.join(F.broadcast(names.select(F.col("index").alias("_i"), F.col(name).alias("_name"))), F.col(index) == F.col("_i"), "left")  # a class is a row
    return j.withColumn(name, failing(F.col("_name").isNull(), F.concat(F.lit("no name of "), F.col(index).cast("string")), F.col("_name"))).drop("_i", "_name")


def one_value(df: DataFrame, column: str):
    """The only value of a column; an error where there are none or several."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if r["a"] is None or r["a"] != r["b"]:
        raise ValueError(f"{column} must have one value, not {r['a']} to {r['b']}")
    return r["a"]


def first_matching(df: DataFrame, condition: F.Column, *order: str):
    """The first row by order that meets the condition; an error where none does."""
    r = df.filter(condition).orderBy(*order).first()
    if r is None:
        raise LookupError("no row meets the condition")
    return r


def class_samples(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_name, path, label) of files (class_name, path) whose class has an index in classes (class_name, label); a class without files gives none. Paths have / for the backslash."""
    return files.join(classes, "class_name").select("class_name", "label", F.translate("path", "\\", "/").alias("path"))


def subset(a: F.Column, b: F.Column) -> F.Column:
    return F.size(F.array_except(a, b)) == 0


def split_back(flat: F.Column, sizes: F.Column) -> F.Column:
    """A concatenation cut back into arrays of the sizes; with F.flatten the round trip of a client's tensors."""
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, x: s + x))
    return F.zip_with(sizes, ends, lambda n, e: F.slice(flat, e - n + 1, n))


def attack_types(round_: F.Column, start: F.Column, end: F.Column, flips: F.Column, scales: F.Column) -> F.Column:
    """The attacks of a round, label_flip before model_update; none outside the active rounds."""
    on = active(round_, start, end)
    return F.array_compact(F.array(F.when(on & flips, F.lit("label_flip")), F.when(on & scales, F.lit("model_update"))))


def job_name(*parts: F.Column | str) -> F.Column:
    """Lower-case parts joined by -, nulls left out."""
    return F.lower(F.concat_ws("-", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]))


def flipped_in_first_round(history: DataFrame, keys: list[str]) -> DataFrame:
    """The most labels any client flipped in the first round's fit: rows (keys, phase, round, client_metrics array of structs); 0 without any."""
    n = F.aggregate(F.transform("client_metrics", lambda c: F.coalesce(c["label_flipped_samples"].cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    first = (F.col("phase") == "fit") & (F.col("round") == 1)
    return history.groupBy(*keys).agg(F.coalesce(F.max(F.when(first, n)), F.lit(0).cast("long")).alias("flipped"))


#: What a round's audit may say of a client.
AUDITED = (
    "client_id", "experiment_id", "train_loss", "local_epochs", "seed", "source_dataset_id", "source_dataset_manifest_sha256", "proximal_mu", "attack_active", "attack_types", "label_flip_attack", "label_flip_source_count",
    "label_flipped_samples", "model_update_attack", "update_scale", "clean_delta_l2", "sent_delta_l2", "trainable_indices_json", "last_layer_indices_json",
)


def client_audit(results: DataFrame) -> DataFrame:
    """The audited columns that results has and num_examples, ordered by client_id as text; what isn't finite is null."""
    kept = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes if c in AUDITED]
    return results.select(*kept, F.col("num_examples").cast("long").alias("num_examples")).orderBy(F.coalesce(F.col("client_id").cast("string"), F.lit("")))


def running_loss(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The mean loss weighted by batch size; 0 without samples."""
    return batches.groupBy(*keys).agg(F.coalesce(F.sum(F.col("loss") * F.col("n")) / F.nullif(F.sum("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("train_loss"), F.sum("n").alias("samples"))


def checked_settings(aggregator: str, clients: int, eval_clients: int = 0, trim: float = 0.25, byzantine: int = 1, keep: int = 0, noise: float = 0.0, clip: float = 1.0, delta: float = 1e-5, clip_only: bool = False, mu: float = 0.0) -> int:
    """The number of evaluating clients (all where 0 was given); settings that make no sense together are an error."""
    evaluating = eval_clients or clients
    private = clip_only or noise > 0
    rules = {
        "evaluating clients must be between 1 and the clients": 1 <= evaluating <= clients,
        "the trimmed share must be at least 0 and below 0.5": 0 <= trim < 0.5,
        "counts of byzantine and of kept clients can't be negative": min(byzantine, keep) >= 0,
        "noise and mu can't be negative": min(noise, mu) >= 0,
        "the clipping norm must be positive": clip > 0,
        "delta must lie between 0 and 1": 0 < delta < 1,
        "clipping only means no noise": not (clip_only and noise > 0),
        "privacy goes with the mean, Krum and MultiKrum only": not private or aggregator in ("fedavg", "krum", "multikrum"),
        f"Krum needs at least {2 * byzantine + 3} clients": aggregator not in ("krum", "multikrum") or clients >= 2 * byzantine + 3,
    }
    if broken := [x for x, ok in rules.items() if not ok]:
        raise ValueError("; ".join(broken))
    return evaluating


def with_class_metrics(runs: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each run and class that its evaluation has; runs without an evaluation are an error, as in a locked analysis."""
    j = runs.join(metrics.withColumn("_seen", F.lit(True)), keys, "left")
    return j.withColumn("class_name", failing(F.col("_seen").isNull(), F.concat(F.lit("no evaluation of "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])), F.col("class_name").cast("string"))).drop("_seen")


def harm_frame(clean: DataFrame, attacked: DataFrame, keys: list[str], ledger: DataFrame) -> DataFrame:
    """Recall lost by the source class, with the labels flipped: clean and attacked have (keys, recall, support), ledger (keys, flipped). A full flip that didn't flip every one of its support is an error."""
    j = clean.select(*keys, F.col("recall").alias("clean")).join(attacked.select(*keys, F.col("recall").alias("attacked"), "support"), keys).join(ledger, keys)
    harm = F.col("clean") - F.col("attacked")
    bad = F.col("flipped") != F.col("support")
    return j.select(*keys, "clean", "attacked", "support", F.when(bad, F.raise_error(F.lit("a full flip left labels")).cast("double")).otherwise(harm).alias("harm"))
