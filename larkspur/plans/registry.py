"""The named queries over the synthetic tables, and SQL that says the same.

Bindings: class = events.event_type, embeddings.label or documents.lang; client
= user_id or vec_id modulo 5; record = a document with its text's SHA-256 and
its first line as leaf; run = mean order price by (status, segment, arm, region).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import accounting, curation, evaluation, federated, formulas, inference, models, partitions, protocol, similarity, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- bindings


def events(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("client"))


def grid(spark, d):
    return partitions.class_client_grid(events(spark, d), "event_type", "client")


GRID = """c AS (SELECT event_type AS class_name, user_id % 5 AS client, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT a.class_name, b.client, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT class_name FROM c) a CROSS JOIN (SELECT DISTINCT client FROM c) b LEFT JOIN c USING (class_name, client))"""


def local_vectors(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("client"), "embedding")
    return vectors.exploded(e, "client", "embedding").groupBy("client", "pos").agg(F.avg("w").alias("w"), F.count("*").alias("n"))


def global_vector(spark, d):
    return vectors.exploded(table(spark, d, "embeddings"), "vec_id", "embedding").groupBy("pos").agg(F.avg("w").alias("w"))


VEC = """x AS (SELECT vec_id % 5 AS client, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
v AS (SELECT client, pos, avg(w) AS w, count(*) AS n FROM x GROUP BY 1, 2), b AS (SELECT pos, avg(w) AS g FROM x GROUP BY 1)"""
KRUM = """d AS (SELECT a.client, b.client AS other, sum((a.w - b.w) * (a.w - b.w)) AS d FROM v a JOIN v b ON a.pos = b.pos AND a.client <> b.client GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY d, other) AS rn FROM d), k AS (SELECT client, sum(d) AS score FROM r WHERE rn <= 2 GROUP BY 1)"""


def predictions(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).when(F.col("vec_id") % 11 == 0, (F.col("label") * 3) % 10).otherwise(F.col("label")).cast("int").alias("predicted"))


PRED = "p AS (SELECT vec_id, label, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 WHEN vec_id % 11 = 0 THEN (label * 3) % 10 ELSE label END)::INT AS predicted FROM embeddings)"
CLASSES = (
    PRED
    + """, s AS (SELECT label AS class, count(*) AS support, sum((label = predicted)::INT)::BIGINT AS tp FROM p GROUP BY 1), q AS (SELECT predicted AS class, count(*) AS said FROM p GROUP BY 1),
j AS (SELECT coalesce(s.class, q.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM s FULL JOIN q ON s.class = q.class),
k AS (SELECT class, support, tp, CASE WHEN said > 0 THEN tp / said::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM j),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM k)"""
)


def records(spark, d):
    docs = table(spark, d, "documents")
    line = F.split("text", "\n")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("lang").alias("class_name"), F.sha2("text", 256).alias("sha256"), F.when(F.size(line) > 1, line[0]).alias("leaf_id"), F.concat("lang", F.lit("-"), "source").alias("group_id"), "doc_id")


REC = """rec AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, lang AS class_name, sha256(text) AS sha256, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS leaf_id, lang || '-' || source AS group_id, doc_id FROM documents)"""


def groups(spark, d):
    return records(spark, d).groupBy("class_name", "group_id").agg(F.count("*").alias("n"))


def splits(spark, d, k=10):
    m = F.col("doc_id") % k
    return records(spark, d).withColumn("split", F.when(m < 7, "train").when(m < 9, "validation").otherwise("test"))


SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END"


def hashes(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"), F.col("label").alias("class_name"), S.sign_bits(F.col("embedding")).alias("h"))


RADIUS = 20
PAIRS = f"""x AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS path, label AS class_name, embedding AS e FROM embeddings),
pairs AS (SELECT a.class_name, a.path AS left_path, b.path AS right_path, list_sum(list_transform(list_zip(a.e, b.e), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::INT AS distance FROM x a JOIN x b ON a.class_name = b.class_name AND a.path < b.path),
h AS (SELECT * FROM pairs WHERE distance <= {RADIUS})"""


def runs(spark, d):
    """(alpha, pair, arm, seed, value): one job each."""
    c, n, o = (table(spark, d, x) for x in ("customer", "nation", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("o_orderstatus").alias("alpha"), F.col("c_mktsegment").alias("pair"), (F.col("o_custkey") % 2).alias("arm"), F.col("n_regionkey").alias("seed")).agg((F.avg("o_totalprice") / 100000).alias("value"))


RUNS = "runs AS (SELECT o_orderstatus AS alpha, c_mktsegment AS pair, o_custkey % 2 AS arm, n_regionkey AS seed, avg(o_totalprice) / 100000 AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"


def diffs(spark, d):
    """Per alpha and seed: the arms' difference of the mean over pairs."""
    block = runs(spark, d).groupBy("alpha", "seed", "arm").agg(F.avg("value").alias("value"))
    return inference.paired(block, "arm", "value", 1, 0, ["alpha", "seed"])


DIFFS = RUNS + ", bl AS (SELECT alpha, seed, arm, avg(value) AS value FROM runs GROUP BY 1, 2, 3), df AS (SELECT a.alpha, a.seed, a.value - b.value AS diff FROM bl a JOIN bl b ON a.alpha = b.alpha AND a.seed = b.seed AND a.arm = 1 AND b.arm = 0)"
MASKS = DIFFS + """, nd AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY alpha) AS n FROM df),
mk AS (SELECT alpha, n, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM (SELECT DISTINCT alpha, n FROM nd)),
st AS (SELECT mk.alpha, mk.n, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -diff ELSE diff END) AS total FROM mk JOIN nd ON mk.alpha = nd.alpha GROUP BY 1, 2, 3),
sf AS (SELECT st.alpha, any_value(st.n) AS n, any_value(o.mean) AS mean, avg((abs(total / st.n) + 1e-12 >= abs(o.mean))::INT::DOUBLE) AS p FROM st JOIN (SELECT alpha, avg(diff) AS mean FROM df GROUP BY 1) o ON st.alpha = o.alpha GROUP BY 1)"""
WILCOX = """, wn AS (SELECT alpha, diff AS v, rank() OVER (PARTITION BY alpha ORDER BY round(abs(diff), 12)) + (count(*) OVER (PARTITION BY alpha, round(abs(diff), 12)) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY alpha ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY alpha) AS n FROM df WHERE abs(diff) > 1e-12),
wm AS (SELECT alpha, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM (SELECT DISTINCT alpha, n FROM wn)),
ws AS (SELECT wm.alpha, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -r ELSE r END) AS total FROM wm JOIN wn ON wm.alpha = wn.alpha GROUP BY 1, 2),
wx AS (SELECT ws.alpha, any_value(o.w) AS w, avg((abs(total) + 1e-9 >= abs(o.w))::INT::DOUBLE) AS p FROM ws JOIN (SELECT alpha, sum(sign(v) * r) AS w FROM wn GROUP BY 1) o ON ws.alpha = o.alpha GROUP BY 1)"""


# ------------------------------------------------------- shares of classes


@query(f"""WITH {GRID}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY class_name)::DOUBLE AS p FROM g), h AS (SELECT class_name, sum(n)::BIGINT AS n, max(p) AS monopoly, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS e, count(*) AS k, sum((n > 0)::INT)::BIGINT AS clients_with_samples FROM p GROUP BY 1)
SELECT class_name, n, round(monopoly, 6) AS monopoly, round(e, 6) + 0 AS entropy, round(CASE WHEN k > 1 THEN e / ln(k) ELSE 0 END, 6) + 0 AS normalized_entropy, round(exp(e), 6) AS effective_clients, clients_with_samples FROM h""")
def class_heterogeneity(spark, d):
    return rounded(partitions.heterogeneity(grid(spark, d)))


@query(f"WITH {GRID} SELECT client, sum(n)::BIGINT AS n, sum((n > 0)::INT)::BIGINT AS classes, round(sum(n) / (SELECT sum(n) FROM g)::DOUBLE, 6) AS share FROM g GROUP BY 1")
def client_totals(spark, d):
    return rounded(partitions.client_totals(grid(spark, d)))


@query(f"WITH {GRID} SELECT client, n FROM g WHERE class_name = 'click' ORDER BY n DESC, client LIMIT 1")
def attacker_by_class(spark, d):
    return partitions.attackers(grid(spark, d), "click")


# ----------------------------------------------------------------- metrics


@query(f"""WITH {CLASSES} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(min(recall) FILTER (support > 0), 6) AS worst_recall, round(quantile_cont(recall, 0.1) FILTER (support > 0), 6) AS p10_recall FROM m""")
def confusion_metrics(spark, d):
    return rounded(evaluation.metrics(evaluation.confusion(predictions(spark, d), "label", "predicted")))


@query(f"WITH {CLASSES} SELECT class, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_metrics(spark, d):
    return rounded(evaluation.class_metrics(evaluation.confusion(predictions(spark, d), "label", "predicted")))


@query(f"""WITH {PRED}, c AS (SELECT label AS target, predicted, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT target, sum(n) AS support, sum(CASE WHEN target = predicted THEN n ELSE 0 END) AS ok FROM c GROUP BY 1)
SELECT c.target, predicted, n, round(n / support::DOUBLE, 6) AS rate, round(n / nullif(support - ok, 0)::DOUBLE, 6) AS share_of_errors FROM c JOIN t ON c.target = t.target WHERE c.target <> predicted""")
def confusion_rates(spark, d):
    return rounded(evaluation.confusion_rates(evaluation.confusion(predictions(spark, d), "label", "predicted")))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), e AS (SELECT vec_id, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rank FROM e) SELECT vec_id, rank, i::INT AS class_index, round(p, 6) AS probability FROM r WHERE rank <= 3""")
def top3_classes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", S.top_k(S.softmax(F.transform("embedding", lambda x: x.cast("double"))), 3).alias("top"))
    return rounded(e.select("vec_id", F.posexplode("top").alias("r", "t")).select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("t.class_index").alias("class_index"), F.col("t.probability").alias("probability")))


# ------------------------------------------------------ vector aggregation


@query(f"WITH {VEC} SELECT pos::INT AS pos, round(sum(w * n) / sum(n), 6) + 0 AS w FROM v GROUP BY 1")
def fedavg_mean(spark, d):
    return rounded(vectors.fedavg(local_vectors(spark, d)))


@query(f"WITH {VEC} SELECT pos::INT AS pos, round(quantile_cont(w, 0.5), 6) + 0 AS w FROM v GROUP BY 1")
def coordinate_median(spark, d):
    return rounded(vectors.coordinate_median(local_vectors(spark, d)))


@query(f"WITH {VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY w, client) AS rn FROM v) SELECT pos::INT AS pos, round(avg(w), 6) + 0 AS w FROM r WHERE rn > 1 AND rn <= 4 GROUP BY 1")
def trimmed_mean(spark, d):
    return rounded(vectors.trimmed_mean(local_vectors(spark, d), 5))


@query(f"WITH {VEC}, {KRUM} SELECT client, round(score, 6) AS score FROM k")
def krum_scores(spark, d):
    return rounded(vectors.krum_scores(local_vectors(spark, d), 5))


@query(f"WITH {VEC}, {KRUM}, z AS (SELECT client FROM k ORDER BY round(score, 9), client LIMIT 4) SELECT pos::INT AS pos, round(sum(w * n) / sum(n), 6) + 0 AS w FROM v WHERE client IN (SELECT client FROM z) GROUP BY 1")
def multikrum_mean(spark, d):
    return rounded(vectors.multikrum(local_vectors(spark, d), 5))


@query(f"WITH {VEC} SELECT client, v.pos::INT AS pos, round(g - 0.5 * (w - g), 6) + 0 AS sent FROM v JOIN b USING (pos)")
def scale_delta(spark, d):
    return rounded(vectors.scaled(local_vectors(spark, d), global_vector(spark, d), -0.5).select("client", "pos", "sent"))


@query(f"WITH {VEC} SELECT client, round(sqrt(sum((w - g) * (w - g))), 6) AS clean_l2, round(0.5 * sqrt(sum((w - g) * (w - g))), 6) AS sent_l2 FROM v JOIN b USING (pos) GROUP BY 1")
def delta_norms(spark, d):
    return rounded(vectors.delta_norms(vectors.scaled(local_vectors(spark, d), global_vector(spark, d), -0.5)))


@query(f"WITH {VEC}, q AS (SELECT client, sqrt(sum((w - g) * (w - g))) AS norm FROM v JOIN b USING (pos) GROUP BY 1) SELECT v.client, v.pos::INT AS pos, round(g + (w - g) * CASE WHEN norm > 0.5 THEN 0.5 / norm ELSE 1 END, 6) + 0 AS w, round(norm, 6) AS norm FROM v JOIN b USING (pos) JOIN q USING (client)")
def clip_update(spark, d):
    return rounded(vectors.clipped(local_vectors(spark, d), global_vector(spark, d), 0.5))


# ---------------------------------------------------------------- curation


@query(f"""WITH RECURSIVE {REC}, ke AS (SELECT path, '0:' || leaf_id AS key FROM rec WHERE leaf_id IS NOT NULL UNION SELECT path, '1:' || sha256 FROM rec), ed AS (SELECT DISTINCT a.path AS x, b.path AS y FROM ke a JOIN ke b USING (key)),
re AS (SELECT path AS x, path AS y FROM rec UNION SELECT re.x, ed.y FROM re JOIN ed ON re.y = ed.x), ro AS (SELECT x AS path, min(y) AS root FROM re GROUP BY 1),
gi AS (SELECT root, 'pv-' || substr(sha256(string_agg(path, chr(10) ORDER BY path)), 1, 20) AS group_id, count(*) AS group_size FROM ro GROUP BY 1) SELECT path, gi.group_id, group_size FROM ro JOIN gi USING (root)""")
def content_groups(spark, d):
    r = records(spark, d).select("path", "leaf_id", "sha256")
    return curation.with_group_id(r, "path", curation.shared_key_components(r, "path", ["leaf_id", "sha256"])).select("path", "group_id", "group_size")


@query(f"WITH {REC}, s AS (SELECT sha256, count(*) AS n, min(class_name) AS a, max(class_name) AS b FROM rec GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS duplicate_sets, coalesce(sum(n), 0)::BIGINT AS duplicate_images, coalesce(sum((a <> b)::INT), 0)::BIGINT AS label_conflicts FROM s")
def exact_duplicate_stats(spark, d):
    return curation.duplicate_sets(records(spark, d), "sha256", "class_name")


@query(f"WITH {REC} SELECT class_name, count(*) AS images, count(leaf_id) AS mapped, count(*) - count(leaf_id) AS unmapped FROM rec GROUP BY 1")
def coverage_by_class(spark, d):
    return curation.coverage(records(spark, d), "class_name", "leaf_id")


@query(f"WITH {REC}, g AS (SELECT class_name FROM rec GROUP BY 1 HAVING count(leaf_id) / greatest(count(*), 1)::DOUBLE >= 0.9) SELECT class_name, count(*) AS images FROM rec WHERE leaf_id IS NOT NULL AND class_name IN (SELECT class_name FROM g) GROUP BY 1")
def eligible_classes(spark, d):
    return curation.eligible(records(spark, d), "class_name", "leaf_id", 0.9).groupBy("class_name").agg(F.count("*").alias("images"))


@query(f"WITH {REC}, z AS (SELECT *, {SPLIT} AS split FROM rec), c AS (SELECT class_name, split, count(*) AS images, count(DISTINCT group_id) AS groups FROM z GROUP BY 1, 2) SELECT a.class_name, s.split, coalesce(images, 0) AS images, coalesce(groups, 0) AS groups FROM (SELECT DISTINCT class_name FROM rec) a CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split) s LEFT JOIN c ON a.class_name = c.class_name AND s.split = c.split")
def split_validation(spark, d):
    return curation.split_counts(splits(spark, d), "class_name", "split", partitions.SPLITS)


@query(f"WITH {REC}, z AS (SELECT *, {SPLIT} AS split FROM rec) SELECT sha256 AS key, count(DISTINCT split) AS splits, count(*) AS images FROM z GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark, d):
    return curation.leaks(splits(spark, d), "sha256", "split")


@query(ORACLE_SQL["content_groups"].rsplit("SELECT path, gi.group_id", 1)[0] + ", mg AS (SELECT gi.group_id, count(leaf_id) > 0 AS has_leaf, count(*) > count(DISTINCT sha256) AS has_copy, count(*) AS images FROM ro JOIN gi USING (root) JOIN rec USING (path) GROUP BY 1) SELECT CASE WHEN has_leaf AND has_copy THEN 'leaf_id+sha256' WHEN has_leaf THEN 'leaf_id' WHEN has_copy THEN 'sha256' ELSE 'singleton' END AS group_source, count(*) AS groups, sum(images)::BIGINT AS images FROM mg GROUP BY 1")
def group_sources(spark, d):
    """Why each content group is one, and how many there are."""
    r = records(spark, d).select("path", "leaf_id", "sha256")
    g = curation.with_group_id(r, "path", curation.shared_key_components(r, "path", ["leaf_id", "sha256"]))
    return curation.group_source(g, "group_id", "leaf_id", "sha256").groupBy("group_source").agg(F.count("*").alias("groups"), F.sum("images").alias("images"))


@query(f"""WITH RECURSIVE {REC}, gr AS (SELECT class_name, group_id, count(*) AS n FROM rec GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY n DESC, sha256('20260824:cap:' || group_id), group_id) AS rn FROM gr),
f AS (SELECT class_name, group_id, n, rn, CASE WHEN n <= 60 THEN n ELSE 0 END AS used, n <= 60 AS taken FROM o WHERE rn = 1 UNION ALL SELECT o.class_name, o.group_id, o.n, o.rn, f.used + CASE WHEN f.used + o.n <= 60 THEN o.n ELSE 0 END, f.used + o.n <= 60 FROM f JOIN o ON f.class_name = o.class_name AND o.rn = f.rn + 1) SELECT class_name, group_id, n FROM f WHERE taken""")
def capped_groups(spark, d):
    return partitions.capped_groups(groups(spark, d), 60, 20260824)


def fold_sql(namespace: str, first: str, takers: int, urgency: str, served: bool) -> str:
    """Groups of a class, in order, each to the least urgency; l is the loads, g the class's total, k the taker."""
    waiting = f"(cnt - o.rn + 1 <= {takers} - list_sum(f.served) AND f.served[k] = 1)" if served else "false"
    return f"""WITH RECURSIVE {REC}, gr AS (SELECT class_name, group_id, count(*) AS n FROM rec GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY {first}sha256('{namespace}:' || group_id), group_id) AS rn, count(*) OVER (PARTITION BY class_name) AS cnt, sum(n) OVER (PARTITION BY class_name)::DOUBLE AS g FROM gr),
f AS (SELECT DISTINCT class_name, NULL::VARCHAR AS group_id, 0::BIGINT AS n, 0::BIGINT AS rn, list_transform(range({takers}), lambda k: 0.0::DOUBLE) AS l, list_transform(range({takers}), lambda k: 0) AS served, 0::BIGINT AS taker FROM o UNION ALL
SELECT class_name, group_id, n, rn, list_transform(l, lambda x, k: CASE WHEN k = taker THEN x + n ELSE x END), list_transform(served, lambda x, k: CASE WHEN k = taker THEN 1 ELSE x END), taker FROM
(SELECT *, list_position(u, list_min(u))::BIGINT AS taker FROM (SELECT o.class_name, o.group_id, o.n, o.rn, f.l, f.served, list_transform(range(1, {takers + 1}), lambda k: CASE WHEN {waiting} THEN 1e300::DOUBLE ELSE {urgency} END) AS u FROM f JOIN o ON f.class_name = o.class_name AND o.rn = f.rn + 1)))"""


@query(fold_sql("20260824:split", "n DESC, ", 3, "(f.l[k] - g * ([0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE])[k]) / greatest(g * ([0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE])[k], 1)", True) + " SELECT class_name, group_id, n, ['train', 'validation', 'test'][taker] AS split FROM f WHERE rn > 0")
def split_assignment(spark, d):
    return partitions.split_assignment(groups(spark, d), (0.7, 0.15, 0.15), 20260824)


@query(fold_sql("101:iid", "", 5, "f.l[k]", False) + " SELECT class_name, group_id, n, (taker - 1)::INT AS client FROM f WHERE rn > 0")
def client_assignment_iid(spark, d):
    return partitions.grouped_iid(groups(spark, d), 5, 101)


@query()
def client_assignment_dirichlet(spark, d):
    return partitions.grouped_dirichlet(groups(spark, d), 5, 0.5, 101, least=1)


@query("WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:split:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM k")
def hash_order_split(spark, d):
    return partitions.hash_order_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query("WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:flip:' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label = 3) SELECT vec_id, label FROM k WHERE rn <= greatest(1, floor(n * 0.25))")
def label_flip_positions(spark, d):
    return partitions.label_flip_positions(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 3, 0.25, 42)


@query("WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('5:sample:' || vec_id), vec_id) AS rn FROM embeddings) SELECT vec_id, label FROM k WHERE rn <= 7")
def per_class_sample(spark, d):
    return partitions.per_class_sample(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 7, 5)


@query("SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY sha256('9:round-robin:' || vec_id), vec_id) - 1) % 5)::INT AS client FROM embeddings")
def round_robin_clients(spark, d):
    return partitions.round_robin(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, 9)


@query("""WITH sh AS (SELECT unnest([0, 1, 2, 3]) AS client, unnest([0.1, 0.4, 0.2, 0.3]) AS hi_share), cu AS (SELECT client, sum(hi_share) OVER (ORDER BY client) AS hi, sum(hi_share) OVER (ORDER BY client) - hi_share AS lo FROM sh),
k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('3:dirichlet:' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, client FROM k JOIN cu ON rn > floor(lo * n + 1e-9) AND rn <= floor(CASE WHEN client = 3 THEN 1.0 ELSE hi END * n + 1e-9)""")
def dirichlet_cut_points(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    shares = e.select("label").distinct().crossJoin(spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.2), (3, 0.3)], "client int, share double"))
    return partitions.dirichlet_cuts(e, "label", "vec_id", shares, 3).select("vec_id", "label", "client")


def labelled_records(spark, d):
    """The records that labels knows."""
    return records(spark, d).join(table(spark, d, "labels"), "doc_id")


KNOWN = f"{REC}, known AS (SELECT rec.*, quality, toxic FROM rec JOIN labels USING (doc_id))"


@query(f"WITH {KNOWN} SELECT {SPLIT} AS left_split, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'train' ELSE 'test' END AS right_split, count(*) AS n FROM (SELECT rec.doc_id, known.quality FROM rec LEFT JOIN known USING (path)) GROUP BY 1, 2")
def split_crosstab(spark, d):
    a = splits(spark, d).select("path", "split")
    b = labelled_records(spark, d).filter("quality IS NOT NULL").select("path", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return curation.split_crosstab(a, b, "path")


@query(f"""WITH {KNOWN}, a AS (SELECT class_name, group_id, count(*) AS n FROM rec GROUP BY 1, 2), b AS (SELECT class_name, group_id, count(*) AS n FROM known GROUP BY 1, 2)
SELECT class_name, count(a.n) AS left_groups, count(b.n) AS right_groups, count(*) - count(a.n) AS extra, count(*) - count(b.n) AS missing, coalesce(sum((a.n <> b.n)::INT), 0)::BIGINT AS changed, count(a.n) = count(*) AND count(b.n) = count(*) AND coalesce(sum((a.n <> b.n)::INT), 0) = 0 AS identical FROM a FULL JOIN b USING (class_name, group_id) GROUP BY 1""")
def group_set_compare(spark, d):
    count = lambda r: r.groupBy("class_name", "group_id").agg(F.count("*").alias("n"))
    return curation.group_set_compare(count(records(spark, d)), count(labelled_records(spark, d)))


@query(f"WITH {KNOWN} SELECT count(*) AS shared_paths FROM (SELECT path FROM known WHERE quality = 1 INTERSECT SELECT path FROM known WHERE toxic = 0)")
def path_overlap(spark, d):
    r = labelled_records(spark, d)
    return r.filter("quality = 1").select("path").intersect(r.filter("toxic = 0").select("path")).agg(F.count("*").alias("shared_paths"))


@query(f"WITH {KNOWN} SELECT class_name, group_id FROM rec EXCEPT SELECT class_name, group_id FROM known WHERE toxic = 1")
def group_difference(spark, d):
    return records(spark, d).select("class_name", "group_id").subtract(labelled_records(spark, d).filter("toxic = 1").select("class_name", "group_id"))


@query(f"WITH {REC}, s AS (SELECT count(*) AS n FROM rec GROUP BY sha256 HAVING count(*) > 1) SELECT count(*) AS images, count(leaf_id) AS known, count(DISTINCT leaf_id) AS leaves, count(DISTINCT group_id) AS groups, count(*) - count(leaf_id) AS unknown, (SELECT count(*) FROM s) AS duplicate_sets, (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS duplicate_images FROM rec")
def grouping_audit(spark, d):
    return curation.grouping_audit(records(spark, d), "leaf_id", "sha256", "group_id")


# -------------------------------------------------------------- similarity


@query(f"WITH {PAIRS} SELECT class_name, left_path, right_path, distance FROM h")
def hamming_pairs(spark, d):
    return similarity.hamming_pairs(hashes(spark, d), "path", "class_name", "h", RADIUS)


@query(f"WITH {PAIRS} SELECT 'p' || lpad(distance::VARCHAR, 2, '0') AS bucket, count(*) AS n FROM h GROUP BY 1")
def hamming_histogram(spark, d):
    return similarity.histogram(hamming_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT min(distance)::DOUBLE AS min, quantile_cont(distance, 0.25) AS p25, quantile_cont(distance, 0.5) AS median, quantile_cont(distance, 0.75) AS p75, round(quantile_cont(distance, 0.95), 6) AS p95, max(distance)::DOUBLE AS max FROM h")
def hamming_quantiles(spark, d):
    return rounded(similarity.quantiles(hamming_pairs(spark, d), "distance"))


# --------------------------------------------------------------- inference


@query(f"WITH {DIFFS} SELECT alpha, seed, round(diff, 6) + 0 AS diff FROM df")
def paired_diff(spark, d):
    return rounded(diffs(spark, d))


@query(f"WITH {RUNS}, b AS (SELECT alpha, seed, avg(value) AS m, sum(value) AS s, count(*) AS c FROM runs GROUP BY 1, 2) SELECT alpha, round(avg(m), 6) AS mean, count(*) AS seeds, round(sum(s) / sum(c), 6) AS jobs_mean FROM b GROUP BY 1")
def seed_block_mean(spark, d):
    return rounded(inference.seed_block_mean(runs(spark, d), "seed", "value", ["alpha"]))


@query(f"WITH {RUNS}, e AS (SELECT pair, count(*) AS n, avg(value) AS m FROM runs GROUP BY 1) SELECT pair, n, round(m, 6) AS mean FROM e UNION ALL SELECT 'unweighted_pair_mean', sum(n)::BIGINT, round(avg(m), 6) FROM e")
def pair_mean_of_means(spark, d):
    return rounded(inference.mean_of_means(runs(spark, d), "pair", "value"))


@query(f"WITH {MASKS} SELECT alpha, n, round(mean, 6) + 0 AS mean, round(p, 6) AS p FROM sf")
def sign_flip_p(spark, d):
    return rounded(inference.sign_flip_p(diffs(spark, d), ["alpha"], "diff").withColumn("n", F.col("n").cast("long")))


@query(f"WITH {DIFFS}{WILCOX} SELECT alpha, round(w, 6) + 0 AS w, round(p, 6) AS p FROM wx")
def wilcoxon_exact(spark, d):
    return rounded(inference.wilcoxon_p(diffs(spark, d), ["alpha"], "diff"))


@query(f"""WITH {MASKS}{WILCOX} SELECT df.alpha, count(*) AS n, round(avg(diff), 6) + 0 AS mean, round(stddev_samp(diff), 6) AS sd, round(avg(diff) / stddev_samp(diff), 6) + 0 AS dz, sum((diff > 0)::INT)::BIGINT AS n_positive, sum((diff < 0)::INT)::BIGINT AS n_negative, sum((abs(diff) < 1e-15)::INT)::BIGINT AS n_zero,
(min(sign(round(diff, 12))) = max(sign(round(diff, 12)))) AND max(sign(round(diff, 12))) <> 0 AS all_same_sign, round(any_value(sf.p), 6) AS permutation_p, round(any_value(wx.p), 6) AS wilcoxon_p FROM df JOIN sf ON df.alpha = sf.alpha JOIN wx ON df.alpha = wx.alpha GROUP BY 1""")
def test_bundle(spark, d):
    return rounded(inference.test_bundle(diffs(spark, d), ["alpha"], "diff"))


@query(f"""WITH {MASKS}, o AS (SELECT 'all' AS family, alpha, p, (count(*) OVER () - row_number() OVER (ORDER BY p, alpha) + 1) * p AS raw FROM sf) SELECT family, alpha, round(p, 6) AS p, round(least(1, max(raw) OVER (ORDER BY p, alpha ROWS UNBOUNDED PRECEDING)), 6) AS holm_p, least(1, max(raw) OVER (ORDER BY p, alpha ROWS UNBOUNDED PRECEDING)) < 0.05 AS reject FROM o""")
def holm_adjust(spark, d):
    p = inference.sign_flip_p(diffs(spark, d), ["alpha"], "diff").select(F.lit("all").alias("family"), "alpha", "p")
    return rounded(inference.holm(p, "family", "p", "alpha"))


@query(f"SELECT t.*, h.holm_p, h.reject FROM ({ORACLE_SQL['test_bundle']}) t JOIN ({ORACLE_SQL['holm_adjust']}) h USING (alpha)")
def family_f1(spark, d):
    """The first confirmatory family: the paired arms at each alpha, adjusted over the alphas."""
    return rounded(inference.family(diffs(spark, d), "alpha", "diff").drop("family"))


#: The resamples of the original.
RESAMPLES = 10_000


@query(f"""WITH {DIFFS}, nd AS (SELECT alpha, diff, row_number() OVER (PARTITION BY alpha ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY alpha) AS n FROM df), dr AS (SELECT alpha, n, rep, unnest(range(0, n)) AS d FROM (SELECT DISTINCT alpha, n FROM nd) CROSS JOIN (SELECT unnest(range(0, 10000)) AS rep)),
pk AS (SELECT alpha, rep, ('0x' || substr(sha256('20260824:' || rep || ':' || d), 1, 8))::BIGINT % n AS i FROM dr), me AS (SELECT pk.alpha, rep, avg(diff) AS m FROM pk JOIN nd ON pk.alpha = nd.alpha AND pk.i = nd.i GROUP BY 1, 2) SELECT alpha, round(quantile_cont(m, 0.025), 6) + 0 AS lo, round(quantile_cont(m, 0.975), 6) + 0 AS hi FROM me GROUP BY 1""")
def bootstrap_ci(spark, d):
    return rounded(inference.bootstrap_ci(diffs(spark, d), ["alpha"], "diff", RESAMPLES, 20260824))


@query(ORACLE_SQL["bootstrap_ci"])
def bootstrap_ci_whole(spark, d):
    return rounded(inference.bootstrap_ci(diffs(spark, d), ["alpha"], "diff", RESAMPLES, 20260824))


XY = "xy AS (SELECT event_id, event_type AS g, user_id % 5 AS seed, value AS x, (extract('hour' FROM ts) + value / 10)::DOUBLE AS y FROM events)"


def xy(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("g"), (F.col("user_id") % 5).alias("seed"), F.col("value").alias("x"), (F.hour("ts") + F.col("value") / 10).cast("double").alias("y"))


@query(f"WITH {XY}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS ry FROM xy) SELECT g, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM r GROUP BY 1")
def spearman_avg_rank(spark, d):
    return rounded(inference.spearman(xy(spark, d), ["g"], "x", "y"))


@query(f"WITH {RUNS}, r AS (SELECT alpha, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY seed) + (count(*) OVER (PARTITION BY seed) - 1) / 2.0::DOUBLE AS ry FROM runs), e AS (SELECT rx - avg(rx) OVER (PARTITION BY alpha) AS ex, ry - avg(ry) OVER (PARTITION BY alpha) AS ey FROM r) SELECT count(*) AS n, round(corr(ex, ey), 6) + 0 AS rho FROM e")
def partial_spearman(spark, d):
    return rounded(inference.partial_spearman(runs(spark, d), "alpha", "value", "seed"))


@query(f"WITH {XY} SELECT g, round(regr_slope(y, x), 6) + 0 AS slope, round(regr_intercept(y, x), 6) + 0 AS intercept, round(regr_r2(y, x), 6) + 0 AS r2, regr_count(y, x)::BIGINT AS n FROM xy GROUP BY 1")
def ols_fit(spark, d):
    return rounded(inference.simple_ols(xy(spark, d), ["g"], "x", "y"))


@query(f"""WITH {XY}, f AS (SELECT s.seed, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT seed FROM xy) s JOIN xy ON xy.seed <> s.seed GROUP BY 1), m AS (SELECT xy.seed, avg((y - a - b * x) * (y - a - b * x)) AS mse FROM xy JOIN f ON xy.seed = f.seed GROUP BY 1) SELECT round(sqrt(avg(mse)), 6) AS rmse, count(*) AS seeds FROM m""")
def loso_rmse(spark, d):
    return rounded(inference.loso_rmse(xy(spark, d), "seed", "x", "y"))


@query(f"WITH {XY} SELECT round(corr(x, y), 6) AS r, round(1 / (1 - corr(x, y) * corr(x, y)), 6) AS vif FROM xy")
def vif(spark, d):
    return rounded(inference.vif(xy(spark, d), "x", "y"))


@query(f"""WITH {RUNS}, w AS (SELECT alpha, pair, avg(value) FILTER (arm = 0) AS clean, avg(value) FILTER (arm = 1) AS attacked, count(*) AS support FROM runs GROUP BY 1, 2), p AS (SELECT *, support / sum(support) OVER (PARTITION BY alpha)::DOUBLE * (clean - attacked) AS part FROM w)
SELECT alpha, round(sum(part), 6) + 0 AS accuracy_drop, round(sum(CASE WHEN pair = 'BUILDING' THEN part ELSE 0 END), 6) + 0 AS source_term, round(sum(CASE WHEN pair = 'BUILDING' THEN 0 ELSE part END), 6) + 0 AS collateral FROM p GROUP BY 1""")
def accuracy_decomposition(spark, d):
    one = lambda k: F.avg(F.when(F.col("arm") == k, F.col("value")))
    w = runs(spark, d).groupBy("alpha", "pair").agg(one(0).alias("clean"), one(1).alias("attacked"), F.count("*").alias("support"))
    return rounded(inference.accuracy_decomposition(w, ["alpha"], F.col("pair") == "BUILDING"))


@query(f"""WITH {RUNS}, a AS (SELECT seed, avg(value) FILTER (arm = 0 AND alpha = 'F') AS baseline_clean, avg(value) FILTER (arm = 0 AND alpha = 'O') AS clean, avg(value) FILTER (arm = 1 AND alpha = 'O') AS attacked FROM runs GROUP BY 1) SELECT seed, round(baseline_clean - attacked, 6) + 0 AS harm, round(baseline_clean - clean, 6) + 0 AS clean_cost, round(clean - attacked, 6) + 0 AS own_harm FROM a""")
def aggregator_decomposition(spark, d):
    one = lambda arm, alpha: F.avg(F.when((F.col("arm") == arm) & (F.col("alpha") == alpha), F.col("value")))
    a = runs(spark, d).groupBy("seed").agg(one(0, "F").alias("baseline_clean"), one(0, "O").alias("clean"), one(1, "O").alias("attacked"))
    return rounded(inference.aggregator_decomposition(a, ["seed"]))


@query(f"WITH {RUNS} SELECT alpha, arm, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM runs GROUP BY 1, 2")
def config_means(spark, d):
    return rounded(runs(spark, d).groupBy("alpha", "arm").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")))


# ------------------------------------------------- accounting and registry


@query(f"""WITH s AS (SELECT DISTINCT p_size AS steps, round(p_retailprice / 500, 1) AS noise, CASE WHEN p_size > 25 THEN 1e-3 ELSE 1e-5 END::DOUBLE AS delta FROM part), o AS (SELECT unnest([{", ".join(map(str, S.RENYI_ORDERS))}])::DOUBLE AS ord), e AS (SELECT *, steps * ord / (2 * noise * noise) + ln(1 / delta) / (ord - 1) AS eps FROM s CROSS JOIN o)
SELECT steps, noise, delta, round(min(eps), 6) AS epsilon, arg_min(ord, eps) AS order FROM e GROUP BY 1, 2, 3""".replace("AS order FROM", 'AS "order" FROM'))
def rdp_epsilon(spark, d):
    """A setting for each size and price of parts: steps, noise, delta."""
    s = table(spark, d, "part").select(F.col("p_size").alias("steps"), F.round(F.col("p_retailprice") / 500, 1).alias("noise"), F.when(F.col("p_size") > 25, 1e-3).otherwise(1e-5).alias("delta")).distinct()
    return accounting.tightest_epsilon(s).withColumn("epsilon", F.round("epsilon", 6))


@query("SELECT alpha, seed, algorithm, epochs FROM (SELECT DISTINCT o_orderstatus AS alpha FROM orders) CROSS JOIN (SELECT DISTINCT n_regionkey AS seed FROM nation) CROSS JOIN (SELECT DISTINCT c_mktsegment AS algorithm FROM customer) CROSS JOIN (SELECT DISTINCT l_linenumber AS epochs FROM lineitem)")
def job_matrix(spark, d):
    """Every combination of what the tables have of each setting."""
    one = lambda t, c, name: formulas.levels(table(spark, d, t).select(F.col(c).alias(name)), name)
    j = accounting.job_matrix(spark, alpha=one("orders", "o_orderstatus", "alpha"), seed=one("nation", "n_regionkey", "seed"), algorithm=one("customer", "c_mktsegment", "algorithm"), epochs=one("lineitem", "l_linenumber", "epochs"))
    return j.select("alpha", F.col("seed").cast("int").alias("seed"), "algorithm", F.col("epochs").cast("int").alias("epochs"))


def rounds(spark, d):
    """Round log: run = event_type, round = the day's rank, failures where a user number divides by 5."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), (F.col("event_id") % 10 + 1).alias("round"), F.col("user_id"))
    return e.groupBy("run", "round").agg(F.count("*").alias("num_clients"), F.sum(((F.col("user_id") % 997 == 0)).cast("long")).alias("num_failures"))


ROUNDS = "ev AS (SELECT event_type AS run, event_id % 10 + 1 AS round, count(*) AS num_clients, sum((user_id % 997 = 0)::INT)::BIGINT AS num_failures FROM events GROUP BY 1, 2)"


@query(f"WITH {ROUNDS}, g AS (SELECT run, count(DISTINCT round) FILTER (round BETWEEN 1 AND 10) AS good_rounds, max(round) AS last_round FROM ev WHERE num_clients > 0 AND num_failures = 0 GROUP BY 1) SELECT r.run, coalesce(good_rounds, 0) AS good_rounds, last_round, coalesce(good_rounds, 0) = 10 AS complete FROM (SELECT DISTINCT run FROM ev) r LEFT JOIN g ON r.run = g.run")
def round_completeness(spark, d):
    return accounting.completeness(rounds(spark, d), ["run"], 10)


@query(f"WITH {ROUNDS}, g AS (SELECT run, count(DISTINCT round) AS k FROM ev WHERE num_failures = 0 AND num_clients > 0 GROUP BY 1), c AS (SELECT r.run, coalesce(k, 0) = 10 AS complete FROM (SELECT DISTINCT run FROM ev) r LEFT JOIN g ON r.run = g.run) SELECT j.run, CASE WHEN complete IS NULL THEN 'pending' WHEN complete THEN 'complete' ELSE 'incomplete' END AS status FROM (SELECT event_type AS run FROM events UNION SELECT role FROM conversations) j LEFT JOIN c ON j.run = c.run")
def job_status(spark, d):
    """Runs are the events' types; the roles of conversations are jobs of which none has run."""
    j = table(spark, d, "events").select(F.col("event_type").alias("run")).union(table(spark, d, "conversations").select("role")).distinct()
    return accounting.status(j, accounting.completeness(rounds(spark, d), ["run"], 10), ["run"])


@query("""WITH e AS (SELECT event_type AS run, event_id % 10 + 1 AS round, user_id % 5 AS client, count(*) AS n FROM events GROUP BY 1, 2, 3), f AS (SELECT *, client = 2 AND NOT (run = 'view' AND round = 3) AS flagged FROM e),
p AS (SELECT run, round, coalesce(bool_and(flagged AND n > 0) FILTER (client = 2), false) AS own, coalesce(bool_or(flagged) FILTER (client <> 2), false) AS others FROM f GROUP BY 1, 2) SELECT run, count(*) AS rounds, bool_and(own) AND NOT bool_or(others) AS verified FROM p GROUP BY 1""")
def attack_verify(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), (F.col("event_id") % 10 + 1).alias("round"), (F.col("user_id") % 5).alias("client")).agg(F.count("*").alias("n"))
    e = e.withColumn("flagged", (F.col("client") == 2) & ~((F.col("run") == "view") & (F.col("round") == 3)))
    return accounting.attack_verified(e, F.col("client") == 2)


@query("""WITH e AS (SELECT event_type AS run, event_id % 10 + 1 AS round, user_id % 5 AS client, count(*) AS n, sum((value > 50)::INT)::BIGINT AS flipped, round(max(value) / 100, 0) * -5 AS scale FROM events GROUP BY 1, 2, 3), f AS (SELECT *, client = 2 AS flagged FROM e),
p AS (SELECT run, round, coalesce(bool_and(n > 0 AND flipped > 0 AND abs(scale + 5) <= 1e-6) FILTER (client = 2), false) AS own FROM f GROUP BY 1, 2) SELECT run, count(*) AS rounds, bool_and(own) AND count(*) = 10 AS verified FROM p GROUP BY 1""")
def attack_verify_strict(spark, d):
    """Ten rounds in which client 2 alone is flagged, flips labels and sends its update by the scale -5."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), (F.col("event_id") % 10 + 1).alias("round"), (F.col("user_id") % 5).alias("client")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("flipped"), (F.round(F.max("value") / 100, 0) * -5).alias("scale"))
    return accounting.attack_verified(e.withColumn("flagged", F.col("client") == 2), F.col("client") == 2, rounds=10, flipped=True, scale=-5.0)


# ------------------------------------------ fits and loops, tested by pytest


@query("""WITH RECURSIVE e AS (SELECT user_id % 5 AS seed, value / 100 AS x, (event_type = 'purchase')::INT::DOUBLE AS k FROM events),
f AS (SELECT 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL SELECT it + 1, b0 + (m11 * s0 - m01 * s1) / (m00 * m11 - m01 * m01), b1 + (m00 * s1 - m01 * s0) / (m00 * m11 - m01 * m01) FROM
  (SELECT it, b0, b1, sum(k - mu) AS s0, sum(x * (k - mu)) AS s1, sum(mu * (1 - mu)) AS m00, sum(x * mu * (1 - mu)) AS m01, sum(x * x * mu * (1 - mu)) AS m11 FROM (SELECT it, b0, b1, x, k, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM f CROSS JOIN e WHERE it < 12) GROUP BY 1, 2, 3)),
l AS (SELECT b0, b1 FROM f WHERE it = 12), r AS (SELECT seed, sum(k - mu) AS s0, sum(x * (k - mu)) AS s1, sum(mu * (1 - mu)) AS m00, sum(x * mu * (1 - mu)) AS m01, sum(x * x * mu * (1 - mu)) AS m11 FROM (SELECT seed, x, k, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM e CROSS JOIN l) GROUP BY 1),
t AS (SELECT sum(m00) AS a, sum(m01) AS b, sum(m11) AS c, sum(s0 * s0) AS p, sum(s0 * s1) AS q, sum(s1 * s1) AS r FROM r)
SELECT 'intercept' AS term, round(b0, 6) + 0 AS estimate, round(sqrt(c * c * p - 2 * b * c * q + b * b * r) / (a * c - b * b), 6) AS robust_se FROM l CROSS JOIN t UNION ALL SELECT 'x', round(b1, 6) + 0, round(sqrt(b * b * p - 2 * a * b * q + a * a * r) / (a * c - b * b), 6) FROM l CROSS JOIN t""")
def glm_gee(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("seed"), (F.col("value") / 100).alias("x"), (F.col("event_type") == "purchase").cast("double").alias("k"), F.lit(1.0).alias("n"))
    f = models.logistic_gee(e, ["x"], "k", "n", "seed")
    return rounded(spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(f["names"], f["estimate"], f["robust_se"], strict=True)], "term string, estimate double, robust_se double"))


@query()
def lmm_reml(spark, d):
    f = models.crossed_lmm(runs(spark, d).withColumn("arm", F.col("arm").cast("double")), ["arm"], "value", ["seed", "pair"])
    rows = [(n, float(b), float(s)) for n, b, s in zip(f["names"], f["estimate"], f["se"], strict=True)]
    return spark.createDataFrame([*rows, *((f"var:{k}", v, None) for k, v in f["variance"].items()), ("residual", float(f["residual"]), None)], "term string, estimate double, se double")


#: Normal equations by sweeps; Student's tail by Simpson's rule.
@query(f"""WITH RECURSIVE {XY}, lo AS (SELECT event_id AS rid, unnest([1, 2, 3, 4, 5]) AS pos, unnest([1, x, (g = 'click')::INT, (g = 'purchase')::INT, y]::DOUBLE[]) AS v FROM xy),
ba AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS v FROM lo a JOIN lo b ON a.rid = b.rid GROUP BY 1, 2),
sw AS (SELECT i, j, v, 0 AS k FROM ba UNION ALL SELECT i, j, CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / d WHEN i = k + 1 THEN v / d WHEN j = k + 1 THEN -v / d ELSE v - c * r / d END, k + 1 FROM
  (SELECT *, max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER () AS d, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY j) AS r, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY i) AS c FROM sw WHERE k < 4)),
te AS (SELECT b.i, b.v AS estimate, sqrt(g.v * (SELECT v FROM sw WHERE k = 4 AND i = 5 AND j = 5) / ((SELECT v FROM ba WHERE i = 1 AND j = 1) - 4)) AS se, (SELECT v FROM ba WHERE i = 1 AND j = 1) - 4 AS df FROM sw b JOIN sw g ON g.k = 4 AND g.i = b.i AND g.j = b.i WHERE b.k = 4 AND b.j = 5 AND b.i <= 4),
st AS (SELECT *, abs(estimate / se) / 4000 AS h, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS f0 FROM te)
SELECT ['intercept', 'x', 'click', 'purchase'][i] AS term, round(estimate, 6) + 0 AS estimate, round(se, 6) AS se, round(greatest(0, 1 - 2 * h / 3 * f0 * list_sum(list_transform(range(4001), lambda s: CASE WHEN s IN (0, 4000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (s * h) * (s * h) / df, -(df + 1) / 2)))), 6) + 0 AS p FROM st""")
def multiple_ols(spark, d):
    x = xy(spark, d).select("x", "y", *[(F.col("g") == g).cast("double").alias(g) for g in ("click", "purchase")])
    f = models.ols(x, ["x", "click", "purchase"], "y")
    return rounded(spark.createDataFrame([(n, float(b), float(s), float(p)) for n, b, s, p in zip(f["names"], f["estimate"], f["se"], f["p"], strict=True)], "term string, estimate double, se double, p double"))


@query()
def federated_loop(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("client"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    h = federated.run_rounds(e, 10, 64, 5, rounds=10)
    return spark.createDataFrame([(r["round"], r["num_clients"], float(r["accuracy_before"]), float(r["norm"])) for r in h], "round int, num_clients int, accuracy_before double, norm double")

# ------------------------------------------------ supports, ledgers, doses


@query(f"""WITH {REC}, z AS (SELECT *, {SPLIT} AS split FROM rec), c AS (SELECT class_name, split, count(*) AS images FROM z GROUP BY 1, 2), g AS (SELECT s.split, coalesce(images, 0) AS n FROM (SELECT DISTINCT class_name FROM rec) a CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split) s LEFT JOIN c ON a.class_name = c.class_name AND s.split = c.split),
p AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY split), 0)::DOUBLE AS p FROM g) SELECT split, min(n) AS least, max(n) AS most, round(coalesce(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / nullif(ln(count(*)), 0), 0), 6) + 0 AS normalized_entropy FROM p GROUP BY 1""")
def class_support(spark, d):
    counts = curation.split_counts(splits(spark, d), "class_name", "split", partitions.SPLITS)
    return rounded(evaluation.class_support(counts, "split", "images"))


@query(f"WITH {PRED}, s AS (SELECT label AS class_name, sum((label = predicted)::INT)::BIGINT AS correct, count(*) AS total FROM p GROUP BY 1) SELECT class_name, correct, total, round(correct / total::DOUBLE, 6) AS class_accuracy, round((SELECT sum(correct) / sum(total)::DOUBLE FROM s), 6) AS accuracy FROM s")
def validation_totals(spark, d):
    each = predictions(spark, d).groupBy((F.col("vec_id") % 5).alias("client"), F.col("label").alias("class_name")).agg(F.sum((F.col("label") == F.col("predicted")).cast("long")).alias("correct"), F.count("*").alias("total"))
    return rounded(evaluation.validation_totals(each))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_run(spark, d):
    return accounting.last_of(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH c AS (SELECT label, vec_id % 5 AS client, count(*) AS n FROM embeddings GROUP BY 1, 2)
SELECT label, client, n, CASE WHEN client = 0 THEN n // 2 WHEN label < 5 THEN n - 1 ELSE least(n, greatest(1, floor(n * 0.6)))::BIGINT END AS flipped, CASE WHEN client = 0 THEN 'ledger' WHEN label < 5 THEN 'history' ELSE 'formula' END AS provenance FROM c""")
def flip_ledger(spark, d):
    c = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 5).alias("client")).agg(F.count("*").alias("n"))
    known = {"ledger": c.filter("client = 0").withColumn("flipped", F.expr("n div 2")), "history": c.filter("label < 5").withColumn("flipped", F.col("n") - 1)}
    return accounting.first_known(c, ["label", "client"], "flipped", known, S.expected_flips(F.col("n"), 0.6))


@query("""WITH o AS (SELECT o_orderstatus AS alpha, o_orderpriority AS pair, o_custkey % 4 AS arm, avg(o_totalprice) / 100000 AS value FROM orders GROUP BY 1, 2, 3), f AS (SELECT alpha, pair, value, CASE arm WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS fraction FROM o WHERE arm > 0)
SELECT f.alpha, f.pair, fraction, round(c.value, 6) AS clean, round(f.value, 6) AS attacked, round(c.value - f.value, 6) + 0 AS harm FROM f JOIN o c ON c.arm = 0 AND c.alpha = f.alpha AND c.pair = f.pair""")
def dose_frame(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("alpha"), F.col("o_orderpriority").alias("pair"), (F.col("o_custkey") % 4).alias("arm")).agg((F.avg("o_totalprice") / 100000).alias("value"))
    fraction = F.when(F.col("arm") == 1, 1.0).when(F.col("arm") == 2, 0.25).otherwise(0.5)
    return rounded(inference.dose_frame(o.filter("arm = 0").drop("arm"), o.filter("arm > 0").withColumn("fraction", fraction).drop("arm"), ["alpha", "pair"]))


@query(f"WITH {RUNS}, e AS (SELECT value - avg(value) OVER (PARTITION BY alpha) AS ex, seed - avg(seed) OVER (PARTITION BY alpha) AS ey FROM runs), q AS (SELECT round(ex, 9) AS ex, round(ey, 9) AS ey FROM e), r AS (SELECT rank() OVER (ORDER BY ex) + (count(*) OVER (PARTITION BY ex) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY ey) + (count(*) OVER (PARTITION BY ey) - 1) / 2.0::DOUBLE AS ry FROM q) SELECT count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM r")
def residual_spearman(spark, d):
    return rounded(inference.residual_spearman(runs(spark, d), "alpha", "value", "seed"))


@query(f"""WITH {RUNS}, c AS (SELECT alpha, seed, row_number() OVER (PARTITION BY alpha ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY alpha) AS n FROM (SELECT DISTINCT alpha, seed FROM runs)), dr AS (SELECT alpha, n, rep, unnest(range(0, n)) AS d FROM (SELECT DISTINCT alpha, n FROM c) CROSS JOIN (SELECT unnest(range(0, 10000)) AS rep)),
pk AS (SELECT alpha, rep, ('0x' || substr(sha256('20260824:' || rep || ':' || d), 1, 8))::BIGINT % n AS i FROM dr), rw AS (SELECT pk.alpha, rep, r.value AS x, r.arm FROM pk JOIN c ON pk.alpha = c.alpha AND pk.i = c.i JOIN runs r ON r.alpha = c.alpha AND r.seed = c.seed),
rk AS (SELECT alpha, rep, rank() OVER (PARTITION BY alpha, rep ORDER BY x) + (count(*) OVER (PARTITION BY alpha, rep, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY alpha, rep ORDER BY arm) + (count(*) OVER (PARTITION BY alpha, rep, arm) - 1) / 2.0::DOUBLE AS ry FROM rw),
s AS (SELECT alpha, rep, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2 HAVING min(rx) < max(rx) AND min(ry) < max(ry)) SELECT alpha, round(quantile_cont(rho, 0.025), 6) + 0 AS lo, round(quantile_cont(rho, 0.975), 6) + 0 AS hi FROM s GROUP BY 1""")
def clustered_spearman_ci(spark, d):
    return rounded(inference.clustered_spearman_ci(runs(spark, d), ["alpha"], "seed", "value", "arm", RESAMPLES, 20260824))


@query(ORACLE_SQL["clustered_spearman_ci"])
def clustered_spearman_ci_whole(spark, d):
    return rounded(inference.clustered_spearman_ci(runs(spark, d), ["alpha"], "seed", "value", "arm", RESAMPLES, 20260824))


# --------------------------------------------------- confirmatory families


def family_sql(ctes: str) -> str:
    """The SQL of a family whose differences are df(alpha, seed, diff), alpha being the member."""
    return f"SELECT q.* EXCLUDE (alpha), alpha AS member FROM ({ORACLE_SQL['family_f1'].replace(DIFFS, ctes)}) q"


def attack_jobs(spark, d):
    """(member, pair, arm, seed, harm, accuracy_drop): one attacked job each."""
    c, n, o = (table(spark, d, x) for x in ("customer", "nation", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    keys = [F.col("o_orderstatus").alias("member"), F.col("c_mktsegment").alias("pair"), (F.col("o_custkey") % 2).alias("arm"), F.col("n_regionkey").alias("seed")]
    return j.groupBy(*keys).agg((F.avg("o_totalprice") / 100000).alias("harm"), (F.avg("c_acctbal") / 10000).alias("accuracy_drop"))


HARMS = "hj AS (SELECT o_orderstatus AS alpha, c_mktsegment AS pair, o_custkey % 2 AS arm, n_regionkey AS seed, avg(o_totalprice) / 100000 AS harm, avg(c_acctbal) / 10000 AS accuracy_drop FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"


@query()
def family_f1_rows(spark, d):
    """family_f1 with the seeded interval of each member."""
    return rounded(inference.family(diffs(spark, d), "alpha", "diff", intervals=True).drop("family"))


@query()
def seeded_spearman(spark, d):
    """The rank correlation's interval from the original's own stream of draws."""
    return rounded(inference.seeded_spearman(runs(spark, d), ["alpha"], "seed", "value", "arm"))


@query(family_sql(RUNS + ", bl AS (SELECT alpha, seed, avg(value) AS value FROM runs GROUP BY 1, 2), df AS (SELECT a.alpha, a.seed, a.value - b.value AS diff FROM bl a JOIN bl b ON a.seed = b.seed AND b.alpha = 'F' AND a.alpha <> 'F')"))
def family_f1b(spark, d):
    """Each alpha against the reference alpha, by seed."""
    block = runs(spark, d).groupBy(F.col("alpha").alias("member"), "seed").agg(F.avg("value").alias("value"))
    return rounded(inference.family(inference.against_reference(block, "member", "F", ["seed"], "value"), "member", "diff").drop("family"))


@query(family_sql(HARMS + ", df AS (SELECT alpha, seed, avg(harm) AS diff FROM hj GROUP BY 1, 2)"))
def family_f2a(spark, d):
    """The harm itself, averaged over a seed's jobs."""
    return rounded(inference.seed_family(attack_jobs(spark, d), "member", "seed", "harm").drop("family"))


@query(family_sql(HARMS + ", df AS (SELECT alpha, seed, avg(harm - accuracy_drop) AS diff FROM hj GROUP BY 1, 2)"))
def family_f2b(spark, d):
    """The harm beyond the drop of accuracy."""
    jobs_ = attack_jobs(spark, d).withColumn("diff", F.col("harm") - F.col("accuracy_drop"))
    return rounded(inference.seed_family(jobs_, "member", "seed", "diff").drop("family"))


@query(family_sql(HARMS + ", pr AS (SELECT a.alpha, a.pair, a.seed, a.harm - b.harm AS diff FROM hj a JOIN hj b ON a.alpha = b.alpha AND a.pair = b.pair AND a.seed = b.seed AND a.arm = 1 AND b.arm = 0), df AS (SELECT alpha, seed, avg(diff) AS diff FROM pr GROUP BY 1, 2)"))
def family_f2c(spark, d):
    """The arms' difference of harm, paired by job."""
    pairs = inference.paired(attack_jobs(spark, d), "arm", "harm", 1, 0, ["member", "pair", "seed"])
    return rounded(inference.seed_family(pairs, "member", "seed", "diff").drop("family"))


@query(family_sql("""fj AS (SELECT o_orderpriority AS alpha, c_mktsegment AS pair, n_regionkey AS seed, avg(o_totalprice) / 100000 AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
pr AS (SELECT a.alpha, a.seed, a.value - b.value AS diff FROM fj a JOIN fj b ON a.pair = b.pair AND a.seed = b.seed AND b.alpha = '1-URGENT' AND a.alpha <> '1-URGENT'),
cl AS (SELECT n_regionkey AS seed, avg(c_acctbal) FILTER (c_custkey % 2 = 1) / 10000 - avg(c_acctbal) FILTER (c_custkey % 2 = 0) / 10000 AS diff FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
df AS (SELECT alpha, seed, avg(diff) AS diff FROM pr GROUP BY 1, 2 UNION ALL SELECT 'clean', seed, diff FROM cl)"""))
def family_f3(spark, d):
    """Four aggregators' recovery against the baseline's jobs, and the clean runs of two sources, adjusted together."""
    c, n, o = (table(spark, d, x) for x in ("customer", "nation", "orders"))
    at = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    j = o.join(at, o["o_custkey"] == at["c_custkey"]).groupBy(F.col("o_orderpriority").alias("member"), F.col("c_mktsegment").alias("pair"), F.col("n_regionkey").alias("seed")).agg((F.avg("o_totalprice") / 100000).alias("value"))
    recovery = inference.against_reference(j, "member", "1-URGENT", ["pair", "seed"], "value").select("member", "seed", "diff")
    clean = at.groupBy((F.col("c_custkey") % 2).alias("arm"), F.col("n_regionkey").alias("seed")).agg((F.avg("c_acctbal") / 10000).alias("value"))
    other = inference.paired(clean, "arm", "value", 1, 0, ["seed"]).select(F.lit("clean").alias("member"), "seed", "diff")
    return rounded(inference.seed_family(recovery.unionByName(other), "member", "seed", "diff").drop("family"))


# ----------------------------------------------- classes, leaves and splits


def split_records(spark, d):
    """Records whose copies share a split, as a valid dataset's do."""
    r = records(spark, d)
    first = F.substring("sha256", 1, 1)
    return r.select("path", "sha256", F.substring("sha256", 1, 12).alias("group_id"), F.when(F.col("leaf_id").isNotNull(), F.substring("sha256", 1, 16)).alias("leaf_id"), F.when(first < "8", "train").when(first < "c", "validation").otherwise("test").alias("split"))


SPLIT_RECORDS = REC + """, sr AS (SELECT path, sha256, substr(sha256, 1, 12) AS group_id, CASE WHEN leaf_id IS NOT NULL THEN substr(sha256, 1, 16) END AS leaf_id, CASE WHEN sha256[1] < '8' THEN 'train' WHEN sha256[1] < 'c' THEN 'validation' ELSE 'test' END AS split FROM rec),
sm AS (SELECT kind, key, min(split) AS split, count(*) AS images FROM (SELECT 'path' AS kind, path AS key, split FROM sr UNION ALL SELECT 'sha', sha256, split FROM sr UNION ALL SELECT 'group', group_id, split FROM sr UNION ALL SELECT 'leaf', leaf_id, split FROM sr) WHERE key IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {SPLIT_RECORDS} SELECT kind, key, split, images FROM sm")
def split_maps(spark, d):
    return protocol.split_maps(split_records(spark, d))


@query(f"WITH {SPLIT_RECORDS} SELECT kind, split, count(*) AS keys, sum(images)::BIGINT AS images FROM sm GROUP BY 1, 2")
def split_map_sizes(spark, d):
    return protocol.map_sizes(protocol.split_maps(split_records(spark, d)))


@query(f"""WITH {REC}, s AS (SELECT DISTINCT source, lang FROM documents), le AS (SELECT source AS stem, lang || ':::' || source AS leaf, CASE lang WHEN 'fr' THEN 'de' ELSE lang END AS c FROM s WHERE lang IN ('en', 'fr'))
SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, d.lang AS class_name, leaf AS leaf_id FROM documents d LEFT JOIN le ON le.stem = d.source AND (d.lang = le.c OR d.lang = split_part(le.leaf, ':::', 1))""")
def leaf_join(spark, d):
    """Leaves are known of two languages; a third takes those of the second by its other prefix."""
    docs = table(spark, d, "documents")
    leaves = docs.filter("lang IN ('en', 'fr')").select(F.col("source").alias("stem"), F.concat("lang", F.lit(":::"), "source").alias("leaf")).distinct()
    own = docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("lang").alias("class_name"), F.col("source").alias("stem"))
    return protocol.with_leaf(own, "stem", "class_name", leaves, spark.createDataFrame([("de", "fr")], "class_name string, prefix string")).drop("stem")


@query("WITH c AS (SELECT p_type AS class_name, p_brand AS folder FROM part GROUP BY 1, 2), f AS (SELECT p_brand AS folder FROM part GROUP BY 1 HAVING max(p_size) >= 50 AND avg(p_retailprice) > 1000), j AS (SELECT class_name, count(f.folder) AS n, min(f.folder) AS folder FROM c LEFT JOIN f USING (folder) GROUP BY 1) SELECT class_name, CASE WHEN n = 1 THEN folder END AS folder, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'several' END AS state FROM j")
def resolved_classes(spark, d):
    p = table(spark, d, "part")
    folders = p.groupBy(F.col("p_brand").alias("folder")).agg(F.max("p_size").alias("s"), F.avg("p_retailprice").alias("m")).filter("s >= 50 AND m > 1000")
    return protocol.resolved_classes(p.select(F.col("p_type").alias("class_name"), F.col("p_brand").alias("folder")).distinct(), folders)


@query(f"WITH {REC} SELECT DISTINCT group_id AS class_name FROM rec WHERE group_id NOT IN (SELECT lang || '-' || source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang IS NOT NULL AND source IS NOT NULL) AND group_id IS NOT NULL")
def unknown_classes(spark, d):
    known = labelled_records(spark, d).filter("toxic = 1").select(F.col("group_id").alias("class_name"))
    return protocol.unknown_classes(records(spark, d).select(F.col("group_id").alias("class_name")), known)


@query("SELECT event_type, user_id % 5 AS client, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS train_loss, sum(user_id % 7 + 1)::BIGINT AS samples FROM events GROUP BY 1, 2")
def running_loss(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("client"), F.col("value").alias("loss"), (F.col("user_id") % 7 + 1).alias("n"))
    return rounded(protocol.running_loss(e, ["event_type", "client"]))


@query("""WITH e AS (SELECT event_type AS run, CASE WHEN event_id % 3 = 0 THEN 'evaluate' ELSE 'fit' END AS phase, event_id % 10 + 1 AS round, user_id % 5 AS client, count(*) AS n FROM events GROUP BY 1, 2, 3, 4)
SELECT run, coalesce(max(n) FILTER (phase = 'fit' AND round = 1 AND client <> 2), 0)::BIGINT AS flipped FROM e GROUP BY 1""")
def flipped_from_history(spark, d):
    """Client 2 reports no count."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.when(F.col("event_id") % 3 == 0, "evaluate").otherwise("fit").alias("phase"), (F.col("event_id") % 10 + 1).alias("round"), (F.col("user_id") % 5).alias("client")).agg(F.count("*").alias("n"))
    metric = F.struct("client", F.when(F.col("client") != 2, F.col("n")).alias("label_flipped_samples"))
    return protocol.flipped_in_first_round(e.groupBy("run", "phase", "round").agg(F.collect_list(metric).alias("client_metrics")), ["run"])


@query(f"WITH {PRED}, r AS (SELECT vec_id % 5 AS run, label, predicted FROM p), m AS (SELECT run, label AS class_name, count(*) AS support, avg((label = predicted)::INT::DOUBLE) AS recall FROM r GROUP BY 1, 2) SELECT j.run, CASE WHEN j.run < 3 THEN 'iid' ELSE 'a01' END AS alpha, class_name::VARCHAR AS class_name, support, round(recall, 6) AS recall FROM (SELECT DISTINCT run FROM r) j JOIN m USING (run)")
def run_class_metrics(spark, d):
    p = predictions(spark, d).withColumn("run", F.col("vec_id") % 5)
    metrics = p.groupBy("run", F.col("label").alias("class_name")).agg(F.count("*").alias("support"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("recall"))
    jobs_ = p.select("run").distinct().withColumn("alpha", F.when(F.col("run") < 3, "iid").otherwise("a01"))
    return rounded(protocol.with_class_metrics(jobs_, metrics, ["run"]))


@query(f"WITH {PRED}, s AS (SELECT vec_id % 5 AS seed, label, count(*) AS support, avg((label = predicted)::INT::DOUBLE) AS clean, avg((label = predicted AND vec_id % 3 > 0)::INT::DOUBLE) AS attacked FROM p GROUP BY 1, 2) SELECT seed, label, round(clean, 6) AS clean, round(attacked, 6) AS attacked, support, round(clean - attacked, 6) + 0 AS harm FROM s")
def full_flip_harm(spark, d):
    right = F.col("label") == F.col("predicted")
    p = predictions(spark, d).withColumn("seed", F.col("vec_id") % 5)
    recall = lambda ok: p.groupBy("seed", "label").agg(F.avg(ok.cast("double")).alias("recall"), F.count("*").alias("support"))
    ledger = p.groupBy("seed", "label").agg(F.count("*").alias("flipped"))
    return rounded(protocol.harm_frame(recall(right), recall(right & (F.col("vec_id") % 3 > 0)), ["seed", "label"], ledger))


@query("SELECT user_id, event_type, lower(event_type || '-c' || (user_id % 5) || CASE WHEN user_id % 2 = 0 THEN '-Even' ELSE '' END) AS job FROM events GROUP BY 1, 2")
def job_names(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    return e.select("user_id", "event_type", protocol.job_name(F.col("event_type"), F.concat(F.lit("c"), F.col("user_id") % 5), F.when(F.col("user_id") % 2 == 0, "Even")).alias("job"))


#: The perceptual audit's own radius; RADIUS is wide, so that pairs are found among vectors' signs.
AUDIT_RADIUS = 8


@query(f"WITH {PAIRS} SELECT class_name, left_path, right_path, distance FROM pairs WHERE distance <= {AUDIT_RADIUS}")
def hamming_pairs_audit(spark, d):
    return similarity.hamming_pairs(hashes(spark, d), "path", "class_name", "h", AUDIT_RADIUS)
