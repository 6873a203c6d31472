"""Tensors, fits, mixed models, resampling, training, evaluations, rules, grids, publishing, configurations and the stateful history."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import formulas, inference, mixed, rules, tensors, training
from larkspur.operators.formulas import factor
from larkspur.operators.tensors import Tensor
from larkspur.sources import config, evaluations, manifests, publish
from larkspur.streaming import history as hist

# ------------------------------------------------------------ tensors

MODEL = [Tensor("features.0.weight", (2, 3), trainable=False), Tensor("features.0.count", (1,), "int64"), Tensor("classifier.0.weight", (2, 2)), Tensor("classifier.3.weight", (2,)), Tensor("classifier.3.bias", (1,), "float64"), Tensor("classifier.10.weight", (2,), trainable=False)]


def state(spark, flats):
    meta = tensors.layout(spark, MODEL)
    return meta, tensors.from_flat(spark.createDataFrame([(i, f) for i, f in enumerate(flats)], "client long, v array<double>"), ["client"], "v", meta)


def test_layout_and_indices(spark):
    meta, s = state(spark, [[float(i) for i in range(16)]])
    assert [r["tensor"] for r in meta.filter(tensors.is_float()).orderBy("tensor").collect()] == [0, 2, 3, 4, 5]
    assert tensors.trainable_indices(meta).first()["indices"] == [2, 3, 4]
    # the last layer is the 10th by number; it is frozen
    assert tensors.last_layer_indices(meta).first()["indices"] == []
    assert tensors.last_layer_indices(meta.filter("tensor < 5")).first()["indices"] == [3, 4]
    rows = {(r["tensor"], r["pos"]): (r["value"], r["whole"]) for r in s.collect()}
    assert rows[(0, 5)] == (5.0, None) and rows[(1, 0)] == (None, 6) and rows[(2, 0)] == (7.0, None) and rows[(5, 1)] == (15.0, None)
    with pytest.raises(Exception, match="a state has 16 entries"):
        state(spark, [[1.0]])[1].collect()


def test_weights_round_trip_and_strictness(spark):
    meta, s = state(spark, [[i + 0.5 for i in range(16)], [float(-i) for i in range(16)]])
    sent = tensors.weights(s, ["client"])
    assert [r["tensor"] for r in sent.filter("client = 0").collect()] == list(range(6))
    back = tensors.with_weights(meta, sent, ["client"])
    key = ["client", "tensor", "pos"]
    assert back.orderBy(*key).select(*s.columns).collect() == s.orderBy(*key).collect()
    with pytest.raises(Exception, match="missing tensor classifier.0.weight"):
        tensors.with_weights(meta, sent.filter("tensor <> 2"), ["client"]).collect()
    with pytest.raises(Exception, match="unexpected tensor 9"):
        tensors.with_weights(meta, sent.unionByName(sent.filter("tensor = 2").withColumn("tensor", F.lit(9))), ["client"]).collect()
    with pytest.raises(Exception, match="another shape"):
        tensors.with_weights(meta, sent.withColumn("values", F.when(F.col("tensor") == 0, F.slice("values", 1, 2)).otherwise(F.col("values"))), ["client"]).collect()


def test_scaled_copies_counters(spark):
    meta = tensors.layout(spark, [Tensor("w", (2,)), Tensor("n", (1,), "int64")])
    flat = lambda v: tensors.from_flat(spark.createDataFrame([(1, v)], "client long, v array<double>"), ["client"], "v", meta)
    local, base = flat([2.0, 0.0, 5.0]), flat([1.0, 2.0, 4.0]).drop("client")
    out = tensors.scaled(local, base, -5.0)
    got = {(r["tensor"], r["pos"]): (r["sent"], r["whole"]) for r in out.collect()}
    assert got == {(0, 0): (-4.0, None), (0, 1): (12.0, None), (1, 0): (None, 5)}
    n = tensors.norms(out, ["client"]).first()
    assert math.isclose(n["sent_l2"], 5 * n["clean_l2"])
    same = {(r["tensor"], r["pos"]): r["sent"] for r in tensors.scaled(local, base, -5.0, F.lit(False)).collect()}
    assert same[(0, 0)] == 2.0
    with pytest.raises(Exception, match="NaN or infinity"):
        tensors.scaled(flat([math.inf, 0.0, 1.0]), base, 2.0).collect()
    with pytest.raises(Exception, match="shapes differ"):
        tensors.scaled(local, base.withColumn("shape", F.array(F.lit(7))), 2.0).collect()


def test_changed_and_clipped(spark):
    meta, s = state(spark, [[1.0] * 16, [0.0] * 16])
    base = state(spark, [[0.0] * 16])[1].drop("client")
    moved = {r["tensor"]: r["l2"] for r in tensors.changed(s, base, ["client"]).collect()}
    assert moved.keys() == {0, 2, 3, 4, 5} and math.isclose(moved[0], math.sqrt(6))
    c = tensors.clipped(s, base, ["client"], [2, 3, 4], 1.0).filter("client = 0").collect()
    joint = math.sqrt(sum(r["value"] ** 2 for r in c if r["tensor"] in (2, 3, 4)))
    assert math.isclose(joint, 1.0, rel_tol=1e-6) and all(r["value"] == 1.0 for r in c if r["tensor"] in (0, 5)) and [r["whole"] for r in c if r["tensor"] == 1] == [1]
    assert all((r["value"] or 0) == 0 and (r["whole"] or 0) == 0 for r in tensors.clipped(s, base, ["client"], [], 1.0).collect())
    a, b = (tensors.noised(s, [3], 1.0, 4).orderBy("client", "tensor", "pos").collect() for _ in range(2))
    assert a == b and all((x["value"] != y["value"]) == (x["tensor"] == 3) for x, y in zip(a, s.orderBy("client", "tensor", "pos").collect(), strict=True))


def test_noise_is_normal(spark):
    meta = tensors.layout(spark, [Tensor("w", (20_000,))])
    s = tensors.from_flat(spark.createDataFrame([(0, [0.0] * 20_000)], "client long, v array<double>"), ["client"], "v", meta)
    r = tensors.noised(s, [0], 3.0, 1).agg(F.avg("value").alias("m"), F.stddev("value").alias("sd")).first()
    assert abs(r["m"]) < 0.1 and abs(r["sd"] - 3) < 0.1


def test_ordered_checkpoint(spark, tmp_path):
    rows = [(r, t, p, float(100 * r + t + p)) for r in (1, 2) for t in (10, 9, 0, 2) for p in (1, 0)]
    manifests.append_checkpoint(spark.createDataFrame(rows, "round int, tensor int, pos int, w double"), str(tmp_path / "c"))
    got = [(r["tensor"], r["pos"], r["round"]) for r in manifests.ordered_checkpoint(spark, str(tmp_path / "c")).collect()]
    assert got == [(t, p, 2) for t in (0, 2, 9, 10) for p in (0, 1)]
    names = spark.createDataFrame([(f"arr_{i}",) for i in (10, 2, 0, 9)], "name string")
    assert [r["name"] for r in manifests.named_arrays(names).collect()] == ["arr_0", "arr_2", "arr_9", "arr_10"]
    with pytest.raises(Exception, match="not a checkpoint"):
        manifests.named_arrays(spark.createDataFrame([("weights",)], "name string")).collect()


# --------------------------------------------------------------- fits


def fit_frame(spark, n=240):
    g = np.random.default_rng(3)
    rows = [(int(s), "abc"[int(a)], "pq"[int(b)], float(x), float(z)) for s, a, b, x, z in zip(g.integers(0, 5, n), g.integers(0, 3, n), g.integers(0, 2, n), 1000 + g.normal(size=n), g.normal(size=n), strict=True)]
    rows = [(*r, 2.0 + (r[1] == "b") - 0.5 * r[3] + 0.3 * r[4] * (r[2] == "q") + float(e)) for r, e in zip(rows, g.normal(size=n) * 0.2, strict=True)]
    return rows, spark.createDataFrame(rows, "seed int, a string, b string, x double, z double, y double")


def matrix(rows):
    return np.array([[1, r[1] == "b", r[1] == "c", r[3], (r[2] == "q") * r[4]] for r in rows], float), np.array([r[5] for r in rows])


TERMS = [factor("a"), "x", (factor("b"), "z")]


def test_ols_equals_numpy(spark):
    rows, df = fit_frame(spark)
    f = formulas.ols(formulas.moments(df, [TERMS, ["x"]], "y", "seed"), TERMS)
    x, y = matrix(rows)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    s2 = e @ e / (len(y) - 5)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    assert [c["term"] for c in f["coefficients"]] == ["intercept", "a[b]", "a[c]", "x", "b[q]:z"]
    assert np.allclose([c["estimate"] for c in f["coefficients"]], beta, rtol=1e-7)
    assert np.allclose([c["se"] for c in f["coefficients"]], se, rtol=1e-6)
    assert math.isclose(f["r2"], 1 - e @ e / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    low, high = f["coefficients"][3]["ci95"]
    assert math.isclose((high - low) / 2 / f["coefficients"][3]["se"], 1.9701, rel_tol=1e-4)  # t of 235


def test_leave_one_out_equals_refits(spark):
    rows, df = fit_frame(spark)
    got = formulas.leave_one_out(formulas.moments(df, [TERMS], "y", "seed"), TERMS)
    x, y = matrix(rows)
    seed = np.array([r[0] for r in rows])
    squares = []
    for s in range(5):
        beta = np.linalg.lstsq(x[seed != s], y[seed != s], rcond=None)[0]
        squares.append(((y[seed == s] - x[seed == s] @ beta) ** 2).mean())
    assert got["n"] == len(rows) and math.isclose(got["rmse"], math.sqrt(np.mean(squares)), rel_tol=1e-8)


def test_factor_with_too_many_levels(spark):
    df = spark.range(100).select(F.col("id").alias("seed"), F.col("id").cast("string").alias("a"), F.rand(1).alias("y"))
    with pytest.raises(ValueError, match="more than 64 levels"):
        formulas.moments(df, [[factor("a")]], "y", "seed")


# ------------------------------------------------------- mixed models


def dense_reml(x, z_of, y, ratio):
    """The REML criterion with the whole covariance matrix."""
    v = np.eye(len(y)) + sum(r * z @ z.T for r, z in zip(ratio, z_of, strict=True))
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ beta
    return np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (len(y) - x.shape[1]) * math.log(e @ vi @ e), beta, e @ vi @ e / (len(y) - x.shape[1]), vi, e


def mixed_frame(jobs=30, per=7, seeds=5, seed=1):
    g = np.random.default_rng(seed)
    js, ss, cs = g.normal(size=jobs), g.normal(size=seeds) * 0.5, g.normal(size=per) * 0.8
    rows = []
    for j in range(jobs):
        for c in range(per - (j % 3)):
            x = float(g.normal())
            rows.append((f"job{j}", j % seeds, f"c{c}", x, 1.0 + 2 * x + js[j] + ss[j % seeds] + cs[c] + 0.4 * float(g.normal())))
    return rows


def one_hot(values):
    names = sorted(set(values))
    return np.array([[v == n for n in names] for v in values], float)


@pytest.mark.parametrize(("small", "large"), [(["s", "c"], None), (["c"], "job"), ([], "job"), (["s", "c"], "job"), (["s"], None)])
def test_mixed_models_minimise_the_dense_criterion(spark, small, large):
    rows = mixed_frame()
    df = spark.createDataFrame([(j, s, c, x, float(y)) for j, s, c, x, y in rows], "job string, s int, c string, x double, y double")
    f = mixed.fit(df, ["x"], "y", small, large)
    cols = {"job": [r[0] for r in rows], "s": [r[1] for r in rows], "c": [r[2] for r in rows]}
    groupings = [*([large] if large else []), *small]
    z = [one_hot(cols[g]) for g in groupings]
    x, y = np.array([[1, r[3]] for r in rows]), np.array([r[4] for r in rows])
    ratio = np.array([f["variance"][g] / f["residual"] for g in groupings])
    value, beta, s2, vi, e = dense_reml(x, z, y, ratio)
    assert np.allclose([c["estimate"] for c in f["coefficients"]], beta, rtol=1e-7) and math.isclose(s2, f["residual"], rel_tol=1e-7)
    assert np.allclose([c["se"] for c in f["coefficients"]], np.sqrt(np.diag(np.linalg.inv(x.T @ vi @ x)) * s2), rtol=1e-7)
    for k in range(len(ratio)):
        for by in (0.99, 1.01):
            near = ratio.copy()
            near[k] *= by
            assert dense_reml(x, z, y, near)[0] >= value - 1e-9
    fitted = x @ beta + sum(r * zz @ zz.T @ vi @ e for r, zz in zip(ratio, z, strict=True))
    said = f["residuals"]
    assert f["converged"] and said["n"] == len(y) and math.isclose(said["resid_sd"], (y - fitted).std(ddof=1), rel_tol=1e-6) and said["n_fitted_outside_01"] == int(((fitted < 0) | (fitted > 1)).sum())


def test_mixed_model_of_ten_thousand_jobs(spark):
    g = np.random.default_rng(5)
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("job"), (F.col("id") % 19).alias("c"), F.randn(1).alias("x"))
    effect = spark.createDataFrame([(i, float(v)) for i, v in enumerate(g.normal(size=10_000))], "job long, e double")
    df = df.join(effect, "job").withColumn("y", 1.0 + 0.5 * F.col("x") + F.col("e") + 0.5 * F.randn(2))
    f = mixed.fit(df, ["x"], "y", ["c"], "job")
    assert abs(f["coefficients"][1]["estimate"] - 0.5) < 0.02 and abs(f["variance"]["job"] - 1) < 0.06 and abs(f["residual"] - 0.25) < 0.01 and f["variance"]["c"] < 0.01


def test_mixed_model_falls_back_and_says_so(spark):
    rows = mixed_frame(40, 4)
    df = spark.createDataFrame([(j, s, c, x, float(y)) for j, s, c, x, y in rows], "job string, s int, c string, x double, y double").withColumn("twin", 2 * F.col("x"))
    f = mixed.fit_or_fallback(df, ["x", "twin"], "y", ["c"], "job", "s")
    assert f["coefficients"] == [] and "don't determine" in f["warning"] and f["method"] is None
    assert mixed.fit_or_fallback(df, ["x"], "y", ["c"], "job", "s")["method"] == "(1|job) + (1|c)"
    many = df.withColumn("c", F.monotonically_increasing_id())
    with pytest.raises(ValueError, match="levels"):
        mixed.fit(many, ["x"], "y", ["c"])
    assert mixed.fit_or_fallback(many, ["x"], "y", ["c"], None, "s")["method"].startswith("fallback")


# ---------------------------------------------------- ranks, resampling


def test_ranks_equal_a_sorted_list(spark):
    g = np.random.default_rng(1)
    rows = [("ab"[int(k)], float(v)) for k, v in zip(g.integers(0, 2, 5_000), g.integers(0, 40, 5_000), strict=True)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = inference.ranked(df, ["k"], "v", "r").distinct().collect()
    for r in got:
        own = sorted(v for k, v in rows if k == r["k"])
        first = own.index(r["v"]) + 1
        assert r["r"] == first + (own.count(r["v"]) - 1) / 2


def test_spearman_of_ties_and_constants(spark):
    df = spark.createDataFrame([("a", float(i % 7), float((i * i) % 11)) for i in range(200)] + [("b", 1.0, float(i)) for i in range(9)] + [("c", None, 1.0), ("c", 2.0, float("nan")), ("d", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["n"], r["rho"]) for r in inference.spearman(df, ["k"], "x", "y").collect()}
    want = {r["k"]: (r["n"], r["rho"]) for r in inference.small_spearman(df.filter("k < 'c'"), ["k"], "x", "y").collect()}
    assert got["a"][0] == 200 and math.isclose(got["a"][1], want["a"][1], rel_tol=1e-9) and got["b"] == (9, None) and got["d"] == (1, None) and "c" not in got


def test_seeded_means_equal_numpys_stream(spark):
    g = np.random.default_rng(2)
    tests = {f"t{n}": g.normal(size=n) for n in (1, 2, 5, 15)}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in tests.items() for i, v in enumerate(vs)], "k string, position int, v double").repartition(5)
    got = {r["k"]: (r["lo"], r["hi"]) for r in inference.seeded_means(df, ["k"], "v").collect()}
    for k, v in tests.items():
        rng = np.random.RandomState(20260824)
        means = np.array([v[rng.randint(0, len(v), size=len(v))].mean() for _ in range(10_000)])
        assert got[k] == tuple(float(x) for x in np.percentile(means, [2.5, 97.5]))


def test_seeded_spearman_equals_numpys_stream(spark):
    g = np.random.default_rng(3)
    rows = [("k", int(s), float(x), float(x + e)) for s, x, e in zip(g.integers(0, 12, 60), g.integers(0, 9, 60), g.normal(size=60) * 3, strict=True)] + [("flat", 1, 1.0, 2.0), ("flat", 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, s int, x double, y double").repartition(4)
    got = {r["k"]: (r["lo"], r["hi"]) for r in inference.seeded_spearman(df, ["k"], "s", "x", "y", reps=500).collect()}
    ranks = lambda v: np.array([sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v])
    by = {s: [r for r in rows if r[0] == "k" and r[1] == s] for s in sorted({r[1] for r in rows if r[0] == "k"})}
    rng, rho = np.random.RandomState(20260824), []
    for _ in range(500):
        drawn = [r for s in rng.choice(list(by), size=len(by), replace=True) for r in by[int(s)]]
        rho.append(np.corrcoef(ranks([r[2] for r in drawn]), ranks([r[3] for r in drawn]))[0, 1])
    assert np.allclose(got["k"], np.percentile(rho, [2.5, 97.5]), atol=1e-12) and got["flat"] == (None, None)


def test_family_with_intervals(spark):
    df = spark.createDataFrame([(m, s, m + s / 10) for m in (0.0, 1.0) for s in range(5)], "member double, seed int, diff double")
    rows = inference.family(df, "member", "diff", intervals=True).collect()
    assert len(rows) == 2 and all(r["boot_lo"] <= r["mean"] <= r["boot_hi"] and r["holm_p"] >= r["permutation_p"] for r in rows)


# ------------------------------------------------------------- training


def plain_adamw(rows, p, orders, w=None, anchor=None):
    w = np.zeros((p.dim + 1, p.classes)) if w is None else w.copy()
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for order in orders:
        for at in range(0, len(order), p.batch):
            b = order[at : at + p.batch]
            x, y = np.array([rows[i][1] for i in b]), np.array([rows[i][2] for i in b])
            z = np.hstack([x, np.ones((len(x), 1))])
            s = np.exp(z @ w - (z @ w).max(1, keepdims=True))
            g = z.T @ (s / s.sum(1, keepdims=True) - np.eye(p.classes)[y]) / len(x)
            if anchor is not None:
                g = g + p.mu * (w - anchor)
            t += 1
            w = w * (1 - p.lr * p.weight_decay)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - p.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + p.eps)
    return w


def sample_rows(n=150, dim=4, classes=3, seed=7):
    g = np.random.default_rng(seed)
    y = g.integers(0, classes, n)
    return [(i, [float(v) for v in g.normal(size=dim) + 2 * np.eye(dim)[c]], int(c)) for i, c in enumerate(y)]


def test_adamw_equals_plain(spark):
    rows, p = sample_rows(), training.AdamW(3, 4, batch=16, lr=0.05, weight_decay=0.01)
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(6)
    history, best, last = training.train(df, df, p, 4, seed=9)
    keys = {(e, r["id"]): r["o"] for e in range(1, 5) for r in df.select("id", F.xxhash64(F.lit(9), F.lit(e), F.col("id").cast("string")).alias("o")).collect()}
    orders = [sorted(range(len(rows)), key=lambda i, e=e: (keys[(e, i)], str(i))) for e in range(1, 5)]
    assert np.allclose(last["w"].reshape(5, 3), plain_adamw(rows, p, orders), atol=1e-12)
    top = max(h["val_acc"] for h in history)
    assert best["val_acc"] == top and best["epoch"] == next(h["epoch"] for h in history if h["val_acc"] == top)
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    assert np.allclose(best["w"].reshape(5, 3), plain_adamw(rows, p, orders[: best["epoch"]]), atol=1e-12)


def test_rounds_equal_plain(spark):
    rows, p = sample_rows(90), training.AdamW(3, 4, batch=8, lr=0.05, mu=0.5)
    df = spark.createDataFrame([(i % 3, i, x, y) for i, x, y in rows], "client long, id long, x array<double>, label int")
    h = training.run_rounds(df, df, p, 2, epochs=2, seed=4)
    keys = {(e, r["id"]): r["o"] for e in (1000, 1001, 2000, 2001) for r in df.select("id", F.xxhash64(F.lit(4), F.lit(e), F.col("id").cast("string")).alias("o")).collect()}
    w = np.zeros((5, 3))
    for r in (1, 2):
        fits = [plain_adamw(rows, p, [sorted(range(c, 90, 3), key=lambda i, e=e: (keys[(e, i)], str(i))) for e in (1000 * r, 1000 * r + 1)], w, w) for c in range(3)]
        w = sum(fits) / 3
    assert np.allclose(h[-1]["weights"].reshape(5, 3), w, atol=1e-12)
    assert [x["round"] for x in h] == [1, 2] and sum(t for _, t in h[-1]["classes"].values()) == 90


def test_client_without_samples_or_state(spark):
    p = training.AdamW(2, 1)
    one = spark.createDataFrame([(1, 1, [1.0], 0), (1, 2, None, 1)], "client long, id long, x array<double>, label int")
    kept = {r["client"]: r for r in training.epoch(one, training.start(spark, [1, 2], p), p, 0, 1).collect()}
    assert (kept[1]["n"], kept[1]["step"], kept[2]["n"], kept[2]["step"]) == (1, 1, 0, 0)
    with pytest.raises(Exception, match="no state"):
        training.epoch(one, training.start(spark, [7], p), p, 0, 1).collect()


# ------------------------------------------- evaluations, rules, grids


def test_evaluations_are_read_from_either_layout(spark, tmp_path):
    doc = {"split": "test", "num_images": 10, "metrics": {"accuracy": 0.5}, "per_class": {"Apple": {"precision": 1, "recall": 0.25, "f1": 0.4, "support": 10}, "Corn": {"precision": 0, "recall": 0.0, "f1": 0, "support": 0}}}
    at = tmp_path / "runs" / "robust" / "a01-s101-krum"
    os.makedirs(at)
    (at / evaluations.FILE).write_text(json.dumps(doc, indent=1))
    assert evaluations.evaluation_path(str(tmp_path / "runs"), "robust", "a01-s101-krum") == str(at / evaluations.FILE)
    rows = evaluations.per_class(evaluations.read(spark, str(tmp_path / "runs"))).orderBy("class_name").collect()
    assert [tuple(r) for r in rows] == [("robust", "a01-s101-krum", "Apple", 0.25, 10, 2), ("robust", "a01-s101-krum", "Corn", 0.0, 0, 0)]
    e = evaluations.read(spark, str(tmp_path / "runs"))
    two = e.unionByName(e.withColumn("experiment_id", F.lit("b c=d")))
    evaluations.write(two, str(tmp_path / "again"))
    assert sorted(map(str, evaluations.read(spark, str(tmp_path / "again")).collect())) == sorted(map(str, two.collect()))
    runs = spark.createDataFrame([("robust", "a01-s101-krum", "Apple"), ("robust", "lost", "Apple")], "folder string, experiment_id string, source_class string")
    assert [r["experiment_id"] for r in evaluations.missing(runs, e).collect()] == ["lost"]
    with pytest.raises(Exception, match="no recall of lost"):
        evaluations.source_recall(runs, evaluations.per_class(e)).collect()


def test_own_baseline_is_a_mean_of_means(spark):
    attacked = spark.createDataFrame([("a", "krum", s, pair, cls, r) for s, pair, cls, r in [(1, "p", "x", 0.5), (2, "p", "x", 0.3), (1, "q", "y", 0.1)]], "alpha string, aggregator string, seed int, pair string, source_class string, source_recall double")
    clean = spark.createDataFrame([("a", "krum", s, cls, 0.9) for s in (1, 2) for cls in ("x", "y")], "alpha string, aggregator string, seed int, source_class string, source_recall double")
    r = evaluations.own_baseline_harm(attacked, clean).first()
    assert math.isclose(r["harm"], ((0.4 + 0.6) / 2 + 0.8) / 2)
    with pytest.raises(Exception, match="no clean run of krum, a, 2, x"):
        evaluations.own_baseline_harm(attacked, clean.filter("seed = 1")).collect()


def test_grids_of_the_original_size_and_a_hole(spark):
    seeds = [101, 211, 307, 401, 503]
    dose = rules.grid(spark, alpha=["a01", "a05", "iid"], seed=seeds, algorithm=["fedavg", "fedprox"], pair=["p", "q", "r"], q=[0.25, 0.5, 1.0])
    assert dose.count() == 270
    keys = ["alpha", "seed", "algorithm", "pair", "q"]
    values = dose.withColumn("harm", F.rand(1))
    assert rules.complete(dose, values, keys).filter("harm IS NOT NULL").count() == 270
    lacking = values.filter("NOT (alpha = 'iid' AND seed = 307 AND algorithm = 'fedavg' AND pair = 'q' AND q = 0.5)")
    assert rules.holes(dose, lacking, keys).count() == 1
    with pytest.raises(Exception, match="no harm of iid, 307, fedavg, q, 0.5"):
        rules.complete(dose, lacking, keys, "harm").agg(F.sum("harm")).collect()
    with pytest.raises(Exception, match="several of harm of"):
        rules.complete(dose, values.unionByName(values.limit(1)), keys, "harm").agg(F.sum("harm")).collect()
    jobs = rules.grid(spark, alpha=["a01", "a05", "iid"], seed=seeds, algorithm=["fedavg", "fedprox"], attack=["none", "p", "q", "r"])
    assert jobs.count() == 120 and jobs.crossJoin(spark.range(19)).count() == 2280


def test_violations_in_one_pass(spark):
    df = spark.createDataFrame([("a", "g1", "A"), ("b", "g1", "B"), ("a", "g2", "A"), (None, "g3", None), ("c", "g3", "A")], "path string, grp string, cls string")
    found = {r["rule"]: (r["broken"], r["example"]) for r in rules.violations(df, [rules.Row("no path", F.col("path").isNull(), F.col("grp")), rules.Row("never", F.col("cls") == "Z", F.col("path")), rules.Key("group spans classes", F.col("grp"), F.col("cls")), rules.Key("path twice", F.col("path"))]).collect()}
    assert found == {"no path": (1, "g3"), "group spans classes": (2, "g1"), "path twice": (1, "a")}
    rules.require(rules.violations(df, [rules.Row("never", F.col("cls") == "Z", F.col("path"))]))
    with pytest.raises(ValueError, match=r"path twice: 1 \(a\)"):
        rules.require(rules.violations(df, [rules.Key("path twice", F.col("path"))]))
    assert rules.violations(df.limit(0), [rules.Key("path twice", F.col("path"))]).collect() == []


def split_documents(folder, change=None):
    """Three split manifests, as a preparation writes them; change(split, document) edits one."""
    for s, paths in {"train": ["A/1.jpg", "A/2.jpg", "B/1.jpg"], "validation": ["A/3.jpg", "B/2.jpg"], "test": ["B/3.jpg", "A/4.jpg"]}.items():
        records = [{"path": p, "class_name": p[0], "group_id": f"g-{p}", "split": s, "sha256": p} for p in paths]
        doc = {"split": s, "dataset_id": "d1", "classes": ["A", "B"], "source": {"raw_root": "/raw"}, "records": records, "samples": [[p, "AB".index(p[0])] for p in paths]}
        if change:
            change(s, doc)
        (folder / f"{s}.json").write_text(json.dumps(doc))


def test_three_splits_are_loaded_and_guarded(spark, tmp_path):
    split_documents(tmp_path)
    r = manifests.three_splits(spark, str(tmp_path))
    assert r.count() == 7 and {x["split"] for x in r.collect()} == {"train", "validation", "test"}

    def broken(change, match, k=[0]):  # noqa: B006
        k[0] += 1
        folder = tmp_path / f"bad{k[0]}"
        os.makedirs(folder)
        split_documents(folder, change)
        with pytest.raises(ValueError, match=match):
            manifests.three_splits(spark, str(folder))

    broken(lambda s, d: s == "test" and d.update(dataset_id="d2"), "dataset")
    broken(lambda s, d: s == "test" and d["source"].update(raw_root="/other"), "raw_root")
    broken(lambda s, d: s == "train" and d["records"][0].update(split="test"), "another split")
    broken(lambda s, d: s == "train" and d["records"][0].update(class_name="Z"), "unknown class")
    broken(lambda s, d: s == "test" and d["records"][0].update(group_id="g-A/1.jpg", class_name="B"), "group")
    broken(lambda s, d: s == "train" and d["samples"].pop(), "samples")
    broken(lambda s, d: s == "train" and d["records"].append(d["records"][0]), "path")


def test_partition_and_validation_documents(spark, tmp_path):
    split_documents(tmp_path)
    part, val, test = (manifests.split_document(spark, str(tmp_path / f"{s}.json")) for s in ("train", "validation", "test"))
    rules.require(manifests.pair_violations(part, val))
    assert {tuple(r) for r in manifests.samples(part, "/data").collect()} == {("/data/A/1.jpg", 0), ("/data/A/2.jpg", 0), ("/data/B/1.jpg", 1)}
    found = lambda a, b: {r["rule"] for r in manifests.pair_violations(a, b).collect()}
    assert found(part, test) == {"evaluation is not of the validation split"}
    assert found(part, val.withColumn("dataset_id", F.lit("x"))) == {"different dataset ids"}
    assert found(part.withColumn("source_dataset_id", F.lit("x")), val) == {"different dataset ids"}
    assert found(part.withColumn("source_dataset_id", F.lit("d1")).withColumn("dataset_id", F.lit("p")), val) == set()
    assert found(part, val.withColumn("classes", F.array(F.lit("B"), F.lit("A")))) == {"different class orders"}
    assert found(part, val.withColumn("samples", part.first()["samples"] and F.array(F.array(F.lit("A/1.jpg"), F.lit("0"))))) == {"training and validation share paths"}
    assert {r["rule"] for r in manifests.load_violations(part).collect()} == {"fewer than 10 images"}
    assert {r["rule"] for r in manifests.load_violations(part.withColumn("classes", F.array(F.lit("A")))).collect()} == {"fewer than 10 images", "fewer than 2 classes"}


# ------------------------------------------------ publishing, settings


def test_publishing_survives_kills_and_reruns(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []

    def made():
        calls.append(1)
        return spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test")).withColumn("class_name", F.lit("A")).withColumn("group_id", F.col("id").cast("string"))

    def killed():
        return made().withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("killed"))).otherwise(F.lit(1)))

    with pytest.raises(Exception, match="killed"):
        publish.publish(killed, path, spark)
    assert publish.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, path)
    first = publish.publish(made, path, spark, ["split"], publish.split_summary)
    assert first["rows"] == 10 and first["summary"]["train"] == {"images": 7, "groups": 7, "classes": {"A": 7}}
    stamp = sorted(os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(os.path.join(path, first["folder"])) for f in fs)
    n = len(calls)
    assert publish.publish(made, path, spark) == first and len(calls) == n
    publish.set_flag(spark, path, "test_evaluated", True)
    again = publish.publish(made, path, spark)
    assert again["flags"] == {"test_evaluated": True} and again["folder"] == first["folder"] and len(calls) == n
    assert stamp == sorted(os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(os.path.join(path, first["folder"])) for f in fs)
    assert publish.read(spark, path).count() == 10
    assert publish.sweep(spark, path) >= 1 and publish.read(spark, path).count() == 10


GOOD = {"seed": 42, "active_rounds": {"start": 2, "end": 4}, "label_flip": {"source_class": "A", "target_class": "B", "fraction": 0.6}, "model_update": {"mode": "scale_delta", "scale": -5.0}}


def test_attack_documents(spark, tmp_path):
    def one(doc, k=[0]):  # noqa: B006
        k[0] += 1
        p = tmp_path / f"c{k[0]}.json"
        p.write_text(doc if isinstance(doc, str) else json.dumps(doc))
        return str(p)

    r = config.attacks(spark, one(GOOD)).first()
    assert (r["seed"], r["active_rounds"]["end"], r["label_flip"]["fraction"], r["model_update"]["scale"]) == (42, 4, 0.6, -5.0)
    r = config.attacks(spark, one({"label_flip": {"source_class": "A", "target_class": "B"}, "model_update": None})).first()
    assert (r["seed"], r["active_rounds"]["start"], r["active_rounds"]["end"], r["label_flip"]["fraction"], r["model_update"]) == (1337, 1, None, 1.0, None)
    bad = {
        r"unknown keys in \$:": GOOD | {"sead": 1}, r"unknown keys in \$.active_rounds": GOOD | {"active_rounds": {"foo": 1}}, r"unknown keys in \$.label_flip": GOOD | {"label_flip": GOOD["label_flip"] | {"x": 1}},
        "scale is no finite": json.dumps(GOOD).replace("-5.0", "1e999"), "scale is no finite number": GOOD | {"model_update": {"scale": "big"}}, r"seed is no whole": GOOD | {"seed": "x"}, "start is below 1": GOOD | {"active_rounds": {"start": 0}}, "end is before": GOOD | {"active_rounds": {"start": 3, "end": 2}},
        "one class for both": GOOD | {"label_flip": {"source_class": "A", "target_class": "A"}}, "fraction is not in": GOOD | {"label_flip": GOOD["label_flip"] | {"fraction": 0}}, "target_class is missing": GOOD | {"label_flip": {"source_class": "A"}}, "mode is not scale_delta": GOOD | {"model_update": {"mode": "sign"}},
        "there is no attack": {"seed": 1}, "is no object": GOOD | {"active_rounds": [1]}, "no JSON": "{", r"active_rounds.start is no whole": GOOD | {"active_rounds": {"start": "one"}},
    }
    for match, doc in bad.items():
        with pytest.raises(ValueError, match=match):
            config.attacks(spark, one(doc))
    assert config.attack_violations(spark, str(tmp_path)).count() >= 14  # all files in one pass
    classes = spark.createDataFrame([("A",)], "class_name string")
    assert [x["class_name"] for x in config.known_classes(config.attacks(spark, str(tmp_path / "c1.json")), classes).collect()] == ["B"]


def test_settings_fall_back(spark):
    raw = spark.createDataFrame([("ROUNDS", " 7 "), ("LR", "fast"), ("NAME", "  "), ("DP", "Yes"), ("OTHER", "1"), ("MU", None), ("OFF", "maybe")], "name string, value string")
    assert config.settings(raw, {"ROUNDS": 3, "LR": 0.1, "NAME": "x", "DP": False, "MU": 0.5, "OFF": True, "ABSENT": 2}) == {"ROUNDS": 7, "LR": 0.1, "NAME": "x", "DP": True, "MU": 0.5, "OFF": False, "ABSENT": 2}


# ------------------------------------------------------------- history


def event(run, r, phase, clients=5, failures=0, loss=0.5, acc=0.5):
    return json.dumps({"experiment_id": run, "round": r, "phase": phase, "num_clients": clients, "num_failures": failures, "loss": loss, "accuracy": acc})


def test_history_ignores_replays_and_late_events(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    os.makedirs(src)

    def feed(name, lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines))
        hist.sink(hist.history(hist.events(spark, src), 70), out, cp).awaitTermination()
        return hist.read(spark, out)

    first = [event("r", i, p) for i in range(1, 71) for p in ("fit", "evaluate") if i != 64 or p == "fit"] + [event("s", 1, "evaluate", failures=1)]
    rows = feed("a.json", first)
    assert rows.count() == 140 and {r["experiment_id"]: (r["good_rounds"], r["complete"]) for r in hist.standing(rows).collect()} == {"r": (69, False), "s": (0, False)}
    rows = feed("b.json", first)  # replayed as a whole
    assert rows.count() == 140
    rows = feed("c.json", [event("r", 2, "evaluate", clients=0), event("r", 64, "evaluate"), event("r", 64, "evaluate")])
    assert rows.filter("status = 'conflict'").count() == 1 and rows.count() == 142
    assert {r["experiment_id"]: (r["good_rounds"], r["complete"]) for r in hist.standing(rows).collect()}["r"] == (70, True)
    assert feed("d.json", first).count() == 142


def test_evaluated_events(spark):
    before = spark.createDataFrame([("r", 1, 5, 0), ("r", 2, 5, 0), ("r", 3, 5, 1)], "run string, round int, num_clients int, num_failures int")
    results = spark.createDataFrame([("r", 1, 0.5, 0.9), ("r", 2, float("nan"), float("inf"))], "run string, round int, loss double, accuracy double")
    got = {r["round"]: (r["phase"], r["loss"], r["accuracy"], r["num_failures"]) for r in hist.evaluated(before, results, ["run"]).collect()}
    assert got == {1: ("evaluate", 0.5, 0.9, 0), 2: ("evaluate", None, None, 0), 3: ("evaluate", None, None, 1)}


# -------------------------------------------------- guards and lookups


def test_decomposition_is_guarded_by_accuracies(spark):
    df = spark.createDataFrame([("r", "a", 30, 0.9, 0.5), ("r", "b", 70, 0.8, 0.8)], "run string, cls string, support long, clean double, attacked double")
    right = spark.createDataFrame([("r", 0.83, 0.71)], "run string, clean_accuracy double, attacked_accuracy double")
    r = inference.accuracy_decomposition(df, ["run"], F.col("cls") == "a", right).first()
    assert math.isclose(r["accuracy_drop"], 0.12) and math.isclose(r["source_term"], 0.12) and abs(r["collateral"]) < 1e-12
    with pytest.raises(Exception, match="accuracies' difference"):
        inference.accuracy_decomposition(df, ["run"], F.col("cls") == "a", right.withColumn("attacked_accuracy", F.lit(0.7))).collect()


def test_balanced_means(spark):
    df = spark.createDataFrame([("k", s, float(v)) for s, v in [(1, 1), (1, 3), (2, 5), (2, 7)]], "k string, seed int, v double")
    assert inference.seed_block_mean(df, "seed", "v", ["k"], balanced=True).first()["mean"] == 4.0
    with pytest.raises(Exception, match="not the mean of jobs"):
        inference.seed_block_mean(df.filter("v < 7"), "seed", "v", ["k"], balanced=True).collect()


def test_maps_and_lookups(spark):
    from larkspur.operators import protocol

    df = spark.createDataFrame([("p1", "g1", "A", "train"), ("p2", "g1", "A", "train"), ("p3", None, "B", "test")], "path string, group_id string, class_name string, split string")
    got = {(r["kind"], r["key"]): r["value"] for r in protocol.record_maps(df).collect()}
    assert got[("group_class", "g1")] == "A" and got[("path_group", "p2")] == "g1" and got[("path_group", "p3")] is None and len(got) == 7
    with pytest.raises(Exception, match="several values of group_class g1"):
        protocol.record_maps(df.withColumn("class_name", F.when(F.col("path") == "p2", "Z").otherwise(F.col("class_name")))).collect()
    assert {tuple(r) for r in protocol.class_counts(df).collect()} == {("train", "A", 2, 1), ("test", "B", 1, 0)}
    names = spark.createDataFrame([(0, "Apple"), (1, "Corn")], "index int, class_name string")
    rows = spark.createDataFrame([("x", 1), ("y", 0)], "path string, label int")
    assert {r["path"]: r["class_name"] for r in protocol.looked_up(rows, "label", names).collect()} == {"x": "Corn", "y": "Apple"}
    with pytest.raises(Exception, match="no name of 9"):
        protocol.looked_up(rows.withColumn("label", F.lit(9)), "label", names).collect()


def test_strict_attack_verification(spark):
    from larkspur.operators import accounting

    rows = [("r", i, c, c == 2, 10, 3 if c == 2 else None, -5.0 if c == 2 else 1.0) for i in range(1, 11) for c in (1, 2)]
    df = spark.createDataFrame(rows, "run string, round int, client int, flagged boolean, n long, flipped long, scale double")
    ok = lambda d, **k: accounting.attack_verified(d, F.col("client") == 2, **k).first()["verified"]
    assert ok(df) and ok(df, rounds=10, flipped=True, scale=-5.0)
    assert not ok(df.filter("round < 10"), rounds=10) and ok(df.filter("round < 10"))
    assert not ok(df, scale=-4.99) and not ok(df.withColumn("flipped", F.when(F.col("round") == 3, 0).otherwise(F.col("flipped"))), flipped=True)
    with pytest.raises(Exception, match="above 1"):
        from larkspur.functions import scalars as S

        spark.range(1).select(S.rdp_to_epsilon(F.lit(1.0), F.lit(1.0), F.lit(1e-5))).collect()
