"""Queries over model states: an embedding is a flattened state of several tensors, a label is a client."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import tensors, training
from larkspur.operators.tensors import Tensor
from larkspur.plans.registry import query, rounded, table

#: 64 entries: a frozen layer with a counter, a trainable layer, the last layer with its counter.
LAYOUT = [Tensor("features.0.weight", (4, 6), trainable=False), Tensor("features.0.batches", (1,), "int64"), Tensor("classifier.0.weight", (5, 4)), Tensor("classifier.0.bias", (4,)), Tensor("classifier.3.weight", (3, 4)), Tensor("classifier.3.bias", (2,), "float64"), Tensor("classifier.3.batches", (1,), "int64")]
SCALE = -5.0
BOUND = 0.1


def states(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layout, each client's mean state, the mean state of all). Counters are numbers of a thousand times the entry."""
    meta = tensors.layout(spark, LAYOUT)
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.withColumn("e", F.transform("e", lambda v, i: F.when(i.isin(24, 63), F.floor(v * 1000).cast("double")).otherwise(v)))
    each = tensors.from_flat(e, ["vec_id", "label"], "e", meta)
    mean = lambda by: each.groupBy(*by, *tensors.META, "pos").agg(F.avg("value").alias("value"), F.floor(F.avg("whole")).alias("whole"))
    return meta, mean(["label"]), mean([])


SIZES = [prod(t.shape) for t in LAYOUT]
LAY = "lay AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.name}', '{t.dtype}', {str(t.trainable and t.dtype != 'int64').lower()}, {sum(SIZES[:i])}, {sum(SIZES[: i + 1])})" for i, t in enumerate(LAYOUT)) + ") t(tensor, name, dtype, trainable, a, z))"
STATES = LAY + """, fl AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
en AS (SELECT vec_id, label, tensor, name, dtype, trainable, k - a AS pos, CASE WHEN dtype LIKE 'float%' THEN v END AS value, CASE WHEN dtype NOT LIKE 'float%' THEN floor(v * 1000)::BIGINT END AS whole FROM fl JOIN lay ON k >= a AND k < z),
lo AS (SELECT label, tensor, name, dtype, trainable, pos, avg(value) AS value, floor(avg(whole))::BIGINT AS whole FROM en GROUP BY ALL), gl AS (SELECT tensor, pos, avg(value) AS g, floor(avg(whole))::BIGINT AS whole_g FROM en GROUP BY ALL),
be AS (SELECT lo.*, g, whole_g FROM lo JOIN gl USING (tensor, pos))"""


@query(f"WITH {LAY} SELECT 'trainable' AS layer, list(tensor ORDER BY tensor)::VARCHAR AS indices FROM lay WHERE trainable UNION ALL SELECT 'last', list(tensor ORDER BY tensor)::VARCHAR FROM lay WHERE trainable AND name LIKE 'classifier.3.%' UNION ALL SELECT 'changed', coalesce(list(DISTINCT tensor ORDER BY tensor)::VARCHAR, '[]') FROM (WITH {STATES} SELECT tensor FROM be WHERE dtype LIKE 'float%' GROUP BY label, tensor HAVING sqrt(sum((value - g) * (value - g))) > 0.085)")
def tensor_indices(spark, d):
    """Which tensors are trainable, in the last layer, and moved by some client by more than 0.085."""
    meta, local, base = states(spark, d)
    moved = tensors.changed(local, base, ["label"], 0.085).agg(F.array_sort(F.collect_list("tensor")).alias("indices"))
    said = lambda df, what: df.select(F.lit(what).alias("layer"), F.col("indices").cast("string").alias("indices"))
    return said(tensors.trainable_indices(meta), "trainable").unionByName(said(tensors.last_layer_indices(meta), "last")).unionByName(said(moved, "changed"))


@query(f"""WITH {STATES}, se AS (SELECT *, CASE dtype WHEN 'float32' THEN (g + {SCALE} * (value - g))::FLOAT::DOUBLE ELSE g + {SCALE} * (value - g) END AS sent FROM be)
SELECT label, tensor, name, dtype, count(*) AS entries, round(sqrt(sum((value - g) * (value - g))), 6) AS clean_l2, round(sqrt(sum((sent - g) * (sent - g))), 5) AS sent_l2, sum(whole)::BIGINT AS whole FROM se GROUP BY ALL""")
def tensor_scale(spark, d):
    """The scaled update of each client's tensors; counters are sent as they are."""
    _, local, base = states(spark, d)
    norm = lambda c: F.sqrt(F.sum((F.col(c) - F.col("g")) * (F.col(c) - F.col("g"))))
    out = tensors.scaled(local, base, SCALE).groupBy("label", "tensor", "name", "dtype").agg(F.count("*").alias("entries"), norm("value").alias("clean_l2"), norm("sent").alias("sent_l2"), F.sum("whole").alias("whole"))
    return out.withColumns({"clean_l2": F.round("clean_l2", 6), "sent_l2": F.round("sent_l2", 5)})


@query(f"""WITH {STATES}, nn AS (SELECT label, sqrt(sum((value - g) * (value - g))) AS norm FROM be WHERE tensor IN (2, 3, 4, 5) GROUP BY 1), cl AS (SELECT be.*, norm, CASE WHEN tensor IN (2, 3, 4, 5) THEN g + (value - g) * CASE WHEN norm > {BOUND} THEN {BOUND} / norm ELSE 1 END ELSE value END AS c FROM be JOIN nn USING (label))
SELECT label, tensor, round(sum(CASE dtype WHEN 'float32' THEN CASE WHEN tensor IN (2, 3, 4, 5) THEN c::FLOAT::DOUBLE ELSE c END ELSE c END), 5) + 0 AS total, round(sqrt(sum((c - g) * (c - g))), 5) AS l2, sum(whole)::BIGINT AS whole FROM cl GROUP BY ALL""")
def tensor_clip(spark, d):
    """The trainable tensors' updates under one bound of their joint norm; frozen tensors and counters as they are."""
    meta, local, base = states(spark, d)
    indices = tensors.trainable_indices(meta).first()["indices"]
    out = tensors.clipped(local, base, ["label"], indices, BOUND).join(base.select("tensor", "pos", F.col("value").alias("g")), ["tensor", "pos"])
    return out.groupBy("label", "tensor").agg((F.round(F.sum("value"), 5) + 0.0).alias("total"), F.round(F.sqrt(F.sum((F.col("value") - F.col("g")) * (F.col("value") - F.col("g")))), 5).alias("l2"), F.sum("whole").alias("whole"))


@query(f"""WITH {STATES}, w AS (SELECT label, tensor, name, list(value ORDER BY pos) FILTER (value IS NOT NULL) AS v, list(whole ORDER BY pos) FILTER (whole IS NOT NULL) AS w FROM lo GROUP BY ALL)
SELECT label, tensor, name, coalesce(len(v), len(w)) AS entries, round(v[1], 6) + 0 AS first, round(v[-1], 6) + 0 AS last, w.w[1] AS whole FROM w""")
def tensor_weights(spark, d):
    """What a client sends, read back into a state and sent again: entries in order."""
    meta, local, _ = states(spark, d)
    back = tensors.with_weights(meta, tensors.weights(local, ["label"]), ["label"])
    w = tensors.weights(back, ["label"])
    return rounded(w.select("label", "tensor", "name", (F.size("values") + F.size("wholes")).alias("entries"), F.try_element_at("values", F.lit(1)).alias("first"), F.try_element_at("values", F.lit(-1)).alias("last"), F.try_element_at("wholes", F.lit(1)).alias("whole")))


def head_samples(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query()
def adamw_training(spark, d):
    """Epochs of one model over all samples, scored on them; best is the first epoch of greatest accuracy."""
    s = head_samples(spark, d)
    history, best, _ = training.train(s, s, training.AdamW(10, 64, batch=32, lr=0.02), 3)
    return rounded(spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_loss"], h["val_acc"], h["epoch"] == best["epoch"]) for h in history], "epoch int, train_loss double, val_loss double, val_acc double, best boolean"))


@query()
def adamw_rounds(spark, d):
    """Rounds of five clients' local epochs with a proximal pull, each evaluated on all samples."""
    s = head_samples(spark, d)
    history = training.run_rounds(s.withColumn("client", F.col("id") % 5), s, training.AdamW(10, 64, batch=32, lr=0.02, mu=0.1), 3)
    return rounded(spark.createDataFrame([(h["round"], h["clients"], h["train_loss"], h["loss"], h["accuracy"]) for h in history], "round int, clients int, train_loss double, loss double, accuracy double"))
