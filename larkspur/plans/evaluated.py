"""Queries over evaluations of runs, the class-by-job frame and its mixed models, guards and grids.

A run is a line status (alpha), an aggregator (by tax) and a seed (by quantity);
a class is a band of discounts, a client a line number. A class counts as
recognised where an item's unit price is above a bound, which an attack on a
pair of classes raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.operators import extension, mixed, protocol, rules
from larkspur.operators.curation import cut
from larkspur.operators.formulas import factor
from larkspur.plans.registry import REC, SPLIT, query, records, rounded, splits, table
from larkspur.sources import evaluations

#: The bounds of clean and attacked runs, and each pair's source class.
BOUNDS = {"clean": 1200.0, "a-b": 1300.0, "c-d": 1450.0}
SOURCES = {"a-b": "a", "c-d": "c"}


def items(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    band = lambda c, bounds: F.when(F.col(c) < bounds[0][0], bounds[0][1]).when(F.col(c) < bounds[1][0], bounds[1][1])
    return x.select(
        F.col("l_linestatus").alias("alpha"), band("l_tax", [(0.025, "mean"), (0.055, "median")]).otherwise("krum").alias("aggregator"), F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("seed"),
        F.when(F.col("l_discount") < 0.025, "a").when(F.col("l_discount") < 0.045, "b").when(F.col("l_discount") < 0.075, "c").otherwise("d").alias("class_name"), F.col("l_linenumber").alias("client"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )


ITEMS = """it AS (SELECT l_linestatus AS alpha, CASE WHEN l_tax < 0.025 THEN 'mean' WHEN l_tax < 0.055 THEN 'median' ELSE 'krum' END AS aggregator, floor((l_quantity - 1) / 10)::INT AS seed, CASE WHEN l_discount < 0.025 THEN 'a' WHEN l_discount < 0.045 THEN 'b' WHEN l_discount < 0.075 THEN 'c' ELSE 'd' END AS class_name, l_linenumber AS client, l_extendedprice / l_quantity AS unit FROM lineitem),
ev AS (SELECT pair, alpha, aggregator, seed, class_name, count(*) AS support, sum((unit > bound)::INT)::BIGINT AS correct FROM it CROSS JOIN (VALUES ('clean', 1200.0), ('a-b', 1300.0), ('c-d', 1450.0)) b(pair, bound) GROUP BY ALL)"""


def evaluated(spark, d) -> DataFrame:
    """(folder, experiment_id, pair, alpha, aggregator, seed, split, num_images, metrics, per_class) of every run."""
    run = ["pair", "alpha", "aggregator", "seed"]
    bounds = F.create_map(*[F.lit(x) for kv in BOUNDS.items() for x in kv])
    each = items(spark, d).withColumn("pair", F.explode(F.array(*map(F.lit, BOUNDS)))).groupBy(*run, "class_name").agg(F.count("*").alias("support"), F.sum((F.col("unit") > bounds[F.col("pair")]).cast("long")).alias("correct"))
    recall = F.col("correct") / F.col("support")
    stats = F.struct(recall.alias("precision"), recall.alias("recall"), recall.alias("f1"), "support")
    out = each.groupBy(*run).agg(F.sum("support").alias("num_images"), (F.sum("correct") / F.sum("support")).alias("a"), F.avg(recall).alias("b"), F.map_from_entries(F.collect_list(F.struct("class_name", stats))).alias("per_class"))
    metrics = F.struct(F.col("a").alias("accuracy"), F.col("b").alias("balanced_accuracy"), F.col("b").alias("macro_f1"), F.lit(float("nan")).alias("loss"))
    clean = F.col("pair") == "clean"
    name = F.concat_ws("-", "alpha", F.concat(F.lit("s"), "seed"), "aggregator", "pair")
    return out.select(F.when(clean, "clean").otherwise("attack").alias("folder"), name.alias("experiment_id"), *run, F.lit("test").alias("split"), "num_images", metrics.alias("metrics"), "per_class")


def written(spark, d) -> tuple[DataFrame, DataFrame]:
    """(runs, a row for each run and class), the classes from documents that were written and read again."""
    from larkspur.sources.publish import remove, shared_folder

    e = cut(evaluated(spark, d))
    root = f"{shared_folder(spark)}/evaluations-{uuid.uuid4().hex}"
    evaluations.write(e.select("folder", "experiment_id", "split", "num_images", "metrics", "per_class"), root)
    classes = cut(evaluations.per_class(evaluations.read(spark, root)))
    remove(spark, root)
    return e.select("folder", "experiment_id", "pair", "alpha", "aggregator", "seed"), classes


@query(f"WITH {ITEMS} SELECT CASE pair WHEN 'clean' THEN 'clean' ELSE 'attack' END AS folder, alpha || '-s' || seed || '-' || aggregator || '-' || pair AS experiment_id, class_name, round(correct / support::DOUBLE, 6) AS recall, support, correct AS n_correct FROM ev")
def run_evaluations(spark, d):
    """Every run's classes, from its evaluation document."""
    return rounded(written(spark, d)[1])


@query(f"""WITH {ITEMS}, re AS (SELECT *, correct / support::DOUBLE AS recall FROM ev), g AS (SELECT a.alpha, a.aggregator, a.pair, avg(c.recall - a.recall) AS m FROM re a JOIN re c ON c.pair = 'clean' AND a.alpha = c.alpha AND a.aggregator = c.aggregator AND a.seed = c.seed AND a.class_name = c.class_name WHERE (a.pair, a.class_name) IN (('a-b', 'a'), ('c-d', 'c')) GROUP BY ALL)
SELECT alpha, aggregator, round(avg(m), 6) + 0 AS harm FROM g GROUP BY ALL""")
def own_baseline_harm(spark, d):
    """Each aggregator's harm against its own clean runs."""
    runs, classes = written(spark, d)
    source = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("pair")]
    attacked = evaluations.source_recall(runs.filter("pair <> 'clean'").withColumn("source_class", source), classes)
    clean = runs.filter("pair = 'clean'").join(classes.select("folder", "experiment_id", F.col("class_name").alias("source_class"), F.col("recall").alias("source_recall")), ["folder", "experiment_id"])
    return rounded(evaluations.own_baseline_harm(attacked, clean))


def class_jobs(spark, d) -> DataFrame:
    """A row for each run and class: recall, support, n_correct, the class's monopoly and entropy among clients, whether it is the attack's source."""
    runs, classes = written(spark, d)
    n = items(spark, d).groupBy("alpha", "seed", "class_name", "client").agg(F.count("*").alias("n"))
    shares = n.groupBy("alpha", "seed", "class_name").agg((F.max("n") / F.sum("n")).alias("monopoly"), ((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.lit(7.0))).alias("entropy"))
    cells = runs.join(classes.select("folder", "experiment_id", "class_name", "recall", "support", "n_correct"), ["folder", "experiment_id"])
    j = rules.complete(cells, shares, ["alpha", "seed", "class_name"], "shares")
    source = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("pair")]
    return j.select(F.col("experiment_id").alias("job"), "alpha", "aggregator", "seed", "class_name", "recall", "support", "n_correct", "monopoly", "entropy", F.coalesce((F.col("class_name") == source).cast("int"), F.lit(0)).alias("targeted"), (F.col("pair") != "clean").cast("int").alias("attack_job"))


@query(f"""WITH {ITEMS}, n AS (SELECT alpha, seed, class_name, client, count(*) AS n FROM it GROUP BY ALL), sh AS (SELECT alpha, seed, class_name, max(n) / sum(n)::DOUBLE AS monopoly, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(7) AS entropy FROM n GROUP BY ALL)
SELECT alpha || '-s' || seed || '-' || aggregator || '-' || pair AS job, alpha, aggregator, seed, class_name, round(correct / support::DOUBLE, 6) AS recall, support, correct AS n_correct, round(monopoly, 6) AS monopoly, round(entropy, 6) AS entropy, CASE WHEN (pair, class_name) IN (('a-b', 'a'), ('c-d', 'c')) THEN 1 ELSE 0 END::INT AS targeted, (pair <> 'clean')::INT AS attack_job FROM ev JOIN sh USING (alpha, seed, class_name)""")
def class_job_frame(spark, d):
    return rounded(class_jobs(spark, d))


AGGREGATOR = factor("aggregator")
BOTH = [("monopoly", "targeted"), (AGGREGATOR, "targeted")]
#: The audit's models: fixed terms, small groupings, a large one.
SPECIFICATIONS = {
    "protocol": (["monopoly", "entropy", AGGREGATOR, "targeted", *BOTH], ["seed", "class_name"], None),
    "job": (["monopoly", "entropy", AGGREGATOR, "targeted", *BOTH], [], "job"),
    "job and class": (["monopoly", "entropy", AGGREGATOR, "targeted", *BOTH], ["class_name"], "job"),
    "attack_job": (["monopoly", "entropy", AGGREGATOR, "attack_job", "targeted", *BOTH], ["seed", "class_name"], None),
    "monopoly only": (["monopoly", AGGREGATOR, "targeted", *BOTH], ["seed", "class_name"], None),
    "entropy only": (["entropy", AGGREGATOR, "targeted", ("entropy", "targeted"), (AGGREGATOR, "targeted")], ["seed", "class_name"], None),
}


@query()
def lmm_audit(spark, d):
    """The mixed models of recall: every coefficient, variance and residual figure of each specification; one that can't be fitted falls back to seeds alone."""
    frame = cut(class_jobs(spark, d))
    rows = []
    for name, (terms, small, large) in SPECIFICATIONS.items():
        f = mixed.fit_or_fallback(frame, terms, "recall", small, large, "seed")
        rows += [(name, f["method"], c["term"], c["estimate"], c["se"], c["p"]) for c in f["coefficients"]]
        rows += [(name, f["method"], f"var:{k}", v, None, None) for k, v in (f["variance"] | {"residual": f["residual"]}).items()]
        rows += [(name, f["method"], f"rows:{k}", None if v is None else float(v), None, None) for k, v in f["residuals"].items()]
    return rounded(spark.createDataFrame(rows, "specification string, method string, term string, estimate double, se double, p double"))


@query(f"WITH {ITEMS}, n AS (SELECT alpha, seed, class_name, client, count(*) AS n FROM it GROUP BY ALL), sh AS (SELECT alpha, seed, class_name, max(n) / sum(n)::DOUBLE AS monopoly, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(7) AS entropy FROM n GROUP BY ALL), f AS (SELECT monopoly, entropy, (pair, class_name) IN (('a-b', 'a'), ('c-d', 'c')) AS targeted FROM ev JOIN sh USING (alpha, seed, class_name)) SELECT 'all' AS rows_of, count(*) AS n, round(corr(monopoly, entropy), 6) AS r, round(1 / (1 - corr(monopoly, entropy) ** 2), 6) AS vif FROM f UNION ALL SELECT 'targeted', count(*), round(corr(monopoly, entropy), 6), round(1 / (1 - corr(monopoly, entropy) ** 2), 6) FROM f WHERE targeted")
def collinearity(spark, d):
    """Monopoly and entropy among all rows and among the targeted ones."""
    f = cut(class_jobs(spark, d))
    one = lambda df, name: df.agg(F.lit(name).alias("rows_of"), F.count("*").alias("n"), F.corr("monopoly", "entropy").alias("r")).withColumn("vif", 1.0 / (1.0 - F.col("r") * F.col("r")))
    return rounded(one(f, "all").unionByName(one(f.filter("targeted = 1"), "targeted")))


@query(f"""WITH {REC}, b AS (SELECT 'group spans classes' AS rule, source AS k, min(lang) <> max(lang) AS bad FROM documents WHERE source IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'path occurs twice', path, count(*) > 1 FROM rec WHERE path IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'content in several groups', sha256, min(group_id) <> max(group_id) FROM rec GROUP BY 1, 2),
r AS (SELECT 'unknown class' AS rule, path AS k FROM rec WHERE class_name NOT IN ('en', 'de') UNION ALL SELECT 'no leaf', path FROM rec WHERE leaf_id IS NULL UNION ALL SELECT 'not text', path FROM rec WHERE path IS NULL)
SELECT rule, count(*) AS broken, min(k) AS example FROM (SELECT rule, k FROM b WHERE bad UNION ALL SELECT * FROM r) GROUP BY 1""")
def rule_violations(spark, d):
    """Six rules of records in one pass: what breaks them, how often, and an example."""
    docs = records(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    path = F.col("path")
    return rules.violations(docs, [
        rules.Row("unknown class", ~F.col("class_name").isin("en", "de"), path), rules.Row("no leaf", F.col("leaf_id").isNull(), path), rules.Row("not text", path.isNull(), path),
        rules.Key("group spans classes", F.col("source"), F.col("class_name")), rules.Key("path occurs twice", path), rules.Key("content in several groups", F.col("sha256"), F.col("group_id")),
    ])


@query(f"WITH {ITEMS} SELECT alpha, aggregator, seed, client FROM (SELECT unnest(['F', 'O']) AS alpha) CROSS JOIN (SELECT unnest(['mean', 'median', 'krum']) AS aggregator) CROSS JOIN (SELECT unnest(range(0, 5)) AS seed) CROSS JOIN (SELECT unnest(range(1, 10)) AS client) WHERE (alpha, aggregator, seed, client) NOT IN (SELECT alpha, aggregator, seed, client FROM it WHERE class_name = 'b')")
def grid_holes(spark, d):
    """The cells of the settings' whole grid in which no item of class b lies."""
    cells = rules.grid(spark, alpha=["F", "O"], aggregator=["mean", "median", "krum"], seed=list(range(5)), client=list(range(1, 10)))
    return rules.holes(cells, items(spark, d).filter("class_name = 'b'").select("alpha", "aggregator", "seed", "client").distinct(), ["alpha", "aggregator", "seed", "client"])


@query(f"WITH {REC} SELECT 'group_class' AS kind, group_id AS key, min(class_name) AS value FROM rec WHERE group_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'path_group', path, min(group_id) FROM rec WHERE path IS NOT NULL GROUP BY 2 UNION ALL SELECT 'path_class', path, min(class_name) FROM rec WHERE path IS NOT NULL GROUP BY 2")
def record_maps(spark, d):
    return protocol.record_maps(records(spark, d))


@query(f"WITH {REC}, z AS (SELECT *, {SPLIT} AS split FROM rec) SELECT split, class_name, count(*) AS images, count(DISTINCT group_id) AS groups FROM z GROUP BY 1, 2")
def class_counts(spark, d):
    return protocol.class_counts(splits(spark, d))


@query(f"""WITH {ITEMS}, re AS (SELECT *, correct / support::DOUBLE AS recall FROM ev), c AS (SELECT alpha, aggregator, sum(correct) / sum(support)::DOUBLE AS accuracy FROM ev WHERE pair = 'clean' GROUP BY 1, 2),
g AS (SELECT a.alpha, a.aggregator, a.pair, avg(c.recall - a.recall) AS m FROM re a JOIN re c ON c.pair = 'clean' AND a.alpha = c.alpha AND a.aggregator = c.aggregator AND a.seed = c.seed AND a.class_name = c.class_name WHERE (a.pair, a.class_name) IN (('a-b', 'a'), ('c-d', 'c')) GROUP BY ALL),
h AS (SELECT alpha, aggregator, round(avg(m), 6) + 0 AS harm FROM g GROUP BY ALL), j AS (SELECT alpha, aggregator, harm, round(accuracy, 6) AS accuracy FROM h JOIN c USING (alpha, aggregator))
SELECT alpha, aggregator, harm, accuracy, row_number() OVER (PARTITION BY alpha ORDER BY harm, accuracy DESC, aggregator) AS place, accuracy > coalesce(max(accuracy) OVER (PARTITION BY alpha ORDER BY harm, accuracy DESC, aggregator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS on_front FROM j""")
def pareto_front(spark, d):
    """Aggregators by harm at each alpha, and whether each has a better clean accuracy than all of less harm."""
    classes = cut(evaluated(spark, d))
    clean = classes.filter("pair = 'clean'").groupBy("alpha", "aggregator").agg((F.sum(F.col("num_images") * F.col("metrics.accuracy")) / F.sum("num_images")).alias("accuracy"))
    j = own_baseline_harm(spark, d).join(rounded(clean), ["alpha", "aggregator"])
    w = W.partitionBy("alpha").orderBy("harm", F.desc("accuracy"), "aggregator")  # an alpha's few aggregators
    best = F.coalesce(F.max("accuracy").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0))
    return j.select("alpha", "aggregator", "harm", "accuracy", F.row_number().over(w).cast("long").alias("place"), (F.col("accuracy") > best).alias("on_front"))


def variants(spark, d) -> tuple[DataFrame, DataFrame]:
    """(the labelled documents, all documents) as records; each side's groups are split by a rule of its own."""
    r = records(spark, d).select("path", "doc_id", "class_name", "sha256", F.concat("class_name", F.lit("-"), F.substring("sha256", 1, 12)).alias("group_id"), F.when(F.col("leaf_id").isNotNull(), F.concat("class_name", F.lit("-"), F.substring("sha256", 1, 16))).alias("leaf_id"))
    digit = F.substring(F.sha2("group_id", 256), 1, 1)
    side = lambda df, a, b: df.withColumn("split", F.when(digit < a, "train").when(digit < b, "validation").otherwise("test"))
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    # a content in two classes would be in two splits: its least class keeps it
    first = r.groupBy("sha256").agg(F.min("class_name").alias("class_name"))
    r = r.join(first, ["sha256", "class_name"], "left_semi")
    return side(r.join(labelled, "doc_id", "left_semi"), "8", "c"), side(r, "a", "d")


VARIANTS = REC + """, fc AS (SELECT sha256, min(class_name) AS class_name FROM rec GROUP BY 1), v AS (SELECT path, doc_id, class_name, sha256, class_name || '-' || substr(sha256, 1, 12) AS group_id, CASE WHEN leaf_id IS NOT NULL THEN class_name || '-' || substr(sha256, 1, 16) END AS leaf_id FROM rec SEMI JOIN fc USING (sha256, class_name)),
fu AS (SELECT *, CASE WHEN sha256(group_id)[1] < 'a' THEN 'train' WHEN sha256(group_id)[1] < 'd' THEN 'validation' ELSE 'test' END AS split FROM v),
ca AS (SELECT *, CASE WHEN sha256(group_id)[1] < '8' THEN 'train' WHEN sha256(group_id)[1] < 'c' THEN 'validation' ELSE 'test' END AS split FROM v SEMI JOIN labels USING (doc_id)),
sd AS (SELECT 'capped' AS side, * FROM ca UNION ALL SELECT 'full', * FROM fu),
mp AS (SELECT DISTINCT side, kind, key, split FROM (SELECT side, 'path' AS kind, path AS key, split FROM sd UNION ALL SELECT side, 'sha', sha256, split FROM sd UNION ALL SELECT side, 'group', group_id, split FROM sd UNION ALL SELECT side, 'leaf', leaf_id, split FROM sd) WHERE key IS NOT NULL),
gs AS (SELECT side, class_name, group_id, min(split) AS split, count(*) AS n FROM sd GROUP BY ALL), gj AS (SELECT coalesce(a.class_name, b.class_name) AS class_name, a.split AS s, b.split AS t, a.n FROM (SELECT * FROM gs WHERE side = 'capped') a FULL JOIN (SELECT * FROM gs WHERE side = 'full') b ON a.class_name = b.class_name AND a.group_id = b.group_id),
gc AS (SELECT class_name, count(s) AS capped, count(t) AS ful, sum((s IS NULL)::INT) AS extra, sum((t IS NULL)::INT) AS missing, sum(coalesce(s <> t, false)::INT) AS changed, sum(CASE WHEN s <> t THEN n ELSE 0 END) AS images FROM gj GROUP BY 1),
pj AS (SELECT coalesce(a.class_name, b.class_name) || '/' || coalesce(a.split, b.split) AS key, a.path AS x, b.path AS y FROM ca a FULL JOIN fu b ON a.path = b.path AND a.class_name = b.class_name AND a.split = b.split), pc AS (SELECT key, count(x) AS a, count(y) AS b, count(CASE WHEN x IS NOT NULL THEN y END) AS inter FROM pj GROUP BY 1),
su AS (SELECT side, class_name, count(*) AS n FROM sd WHERE split = 'test' GROUP BY ALL), sw AS (SELECT side, min(n) AS least, max(n) AS most, sum(n) AS whole, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END AS e FROM su GROUP BY 1),
co AS (SELECT side, count(*) AS a, count(DISTINCT sha256) AS b, count(DISTINCT group_id) AS c FROM sd GROUP BY 1),
al AS (SELECT 'construction ' || side AS section, 'all' AS key, unnest(['n_images', 'n_unique_sha', 'n_groups', 'n_groups_with_class']) AS name, unnest([a, b, c, c])::DOUBLE AS value FROM co UNION ALL SELECT 'construction ' || side, split, 'n_images', count(*) FROM sd GROUP BY 1, 2
UNION ALL SELECT 'overlap ' || a.kind, a.split, coalesce(b.split, 'absent'), count(*) FROM (SELECT * FROM mp WHERE side = 'capped') a LEFT JOIN (SELECT * FROM mp WHERE side = 'full') b ON a.kind = b.kind AND a.key = b.key GROUP BY 1, 2, 3
UNION ALL SELECT 'groups', class_name, unnest(['capped_groups', 'full_groups', 'n_extra_full_groups', 'n_capped_missing_in_full', 'n_shared_groups_changed_split', 'n_capped_images_in_changed_groups', 'identical_group_set']), unnest([capped, ful, extra, missing, changed, images, (extra = 0 AND missing = 0)::INT]) FROM gc WHERE capped > 0
UNION ALL SELECT 'paths', key, unnest(['capped', 'full', 'intersection']), unnest([a, b, inter]) FROM pc
UNION ALL SELECT 'test support ' || side, 'all', unnest(['least', 'most', 'entropy_norm']), unnest([least, most, e]) FROM sw
UNION ALL SELECT 'test support ' || side, class_name, unnest(['support', 'share']), unnest([n, n / whole]) FROM su JOIN sw USING (side))"""


@query(f"WITH {VARIANTS} SELECT section, key, name, round(value, 6) + 0 AS value FROM al")
def scale_extension(spark, d):
    """What changes between the labelled documents and all of them when each is split on its own."""
    capped, full = variants(spark, d)
    return rounded(extension.scale_extension(cut(capped), cut(full)))
