"""The reference's own fixtures and properties of the sequential rules."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import accounting, curation, evaluation, federated, inference, models, partitions, protocol, similarity, vectors
from larkspur.sources import manifests
from larkspur.streaming import rounds


def test_confusion(spark):
    c = spark.createDataFrame([(0, 0, 8), (0, 1, 2), (1, 0, 1), (1, 1, 9)], "target int, predicted int, n long")
    m = evaluation.metrics(c).first()
    assert (m["accuracy"], m["balanced_accuracy"], m["worst_recall"]) == pytest.approx((0.85, 0.85, 0.8))
    assert {r["class"]: r["support"] for r in evaluation.class_metrics(c).collect()} == {0: 10, 1: 10}


def test_metrics_skip_classes_without_support(spark):
    c = spark.createDataFrame([(0, 0, 3), (0, 5, 1)], "target int, predicted int, n long")
    m = evaluation.metrics(c).first()
    assert m["balanced_accuracy"] == pytest.approx(0.75)
    assert evaluation.metrics(c.limit(0)).first()["accuracy"] == 0


def test_flip_positions(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 0, 0, 2, 0, 1, 0])], "i int, label int")
    pick = lambda q: {r["i"] for r in partitions.label_flip_positions(df, "label", "i", 0, q, 42).collect()}
    assert len(pick(0.6)) == 3 and pick(0.6) <= {0, 2, 3, 5, 7} and pick(0.6) == pick(0.6)
    assert pick(0.25) <= pick(0.6) <= pick(1.0) == {0, 2, 3, 5, 7}
    got = df.limit(1).select(*[S.expected_flips(F.lit(n), q).alias(f"x{k}") for k, (n, q) in enumerate([(0, 0.5), (5, 1.0), (3, 0.25), (8, 0.5)])]).first()
    assert tuple(got) == (0, 5, 1, 4)


def test_scale_delta(spark):
    base = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos int, w double")
    local = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.0)], "client int, pos int, w double")
    s = vectors.scaled(local, base, -5)
    assert [r["sent"] for r in s.orderBy("pos").collect()] == [-4.0, 12.0]
    n = vectors.delta_norms(s).first()
    assert n["sent_l2"] == pytest.approx(5 * n["clean_l2"])


def test_round_gate(spark):
    df = spark.createDataFrame([(r, 2, 4) for r in (1, 2, 4, 5)] + [(9, 1, None)], "r int, s int, e int")
    assert [x[0] for x in df.select(S.active(F.col("r"), F.col("s"), F.col("e"))).collect()] == [False, True, True, False, True]


def test_grouping(spark):
    df = spark.createDataFrame([("a1", "h1", "A:::1"), ("a2", "h2", "A:::1"), ("a2-copy", "h2", None), ("a3", "h3", None)], "path string, sha256 string, leaf_id string")
    g = curation.with_group_id(df, "path", curation.shared_key_components(df, "path", ["leaf_id", "sha256"]))
    ids = {r["path"]: r["group_id"] for r in g.collect()}
    assert ids["a1"] == ids["a2"] == ids["a2-copy"] != ids["a3"]
    assert curation.duplicate_sets(df.withColumn("c", F.lit("x")), "sha256", "c").first()["duplicate_sets"] == 1
    chain = spark.createDataFrame([(f"n{i:03}", f"k{i}", f"k{i + 1}") for i in range(40)], "path string, a string, b string")
    roots = curation.shared_key_components(chain.select("path", F.col("a").alias("x"), F.col("b").alias("y")), "path", ["x", "y"])
    assert roots.select("root").distinct().count() == 40  # keys are per column
    line = spark.createDataFrame([(f"n{i:03}", f"k{(i + 1) // 2}", f"j{i // 2}") for i in range(40)], "path string, x string, y string")
    assert curation.shared_key_components(line, "path", ["x", "y"]).select("root").distinct().collect()[0]["root"] == "n000"


def groups_of(spark, classes=("A", "B"), n=12, size=2):
    return spark.createDataFrame([(c, f"{c}{i}", size) for c in classes for i in range(n)], "class_name string, group_id string, n long")


def test_split(spark):
    g = groups_of(spark)
    a, b = (partitions.split_assignment(g, (0.7, 0.15, 0.15), 17).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) == 24
    for c in "AB":
        assert {r["split"] for r in a if r["class_name"] == c} == set(partitions.SPLITS)
    few = partitions.split_assignment(groups_of(spark, ("A",), 3), (0.7, 0.15, 0.15), 1).collect()
    assert {r["split"] for r in few} == set(partitions.SPLITS)
    with pytest.raises(ValueError):
        partitions.split_assignment(g, (0.7, 0.2, 0.2), 17)


def test_cap_equals_the_plain_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [("A", f"g{i}", int(n)) for i, n in enumerate([3, 3, 2, 2, 1])] + [("B", f"b{i}", int(n)) for i, n in enumerate(rng.integers(1, 9, 40))]
    g = spark.createDataFrame(rows, "class_name string, group_id string, n long")
    for cap in (7, 23):
        got = {r["group_id"] for r in partitions.capped_groups(g, cap, 5).collect()}
        want = set()
        for c in "AB":
            left = cap
            for _, k, n in sorted((-n, hashlib.sha256(f"5:cap:{k}".encode()).hexdigest() + k, (k, n)) for cc, k, n in rows if cc == c):
                if n[1] <= left:
                    left -= n[1]
                    want.add(n[0])
        assert got == want


def test_leak_and_crosstab(spark):
    df = spark.createDataFrame([("a", "g", "train"), ("b", "g", "test"), ("c", "h", "train")], "path string, group_id string, split string")
    assert [r["key"] for r in curation.leaks(df, "group_id", "split").collect()] == ["g"]
    x = {(r["left_split"], r["right_split"]): r["n"] for r in curation.split_crosstab(df, df.filter("path <> 'c'"), "path").collect()}
    assert x == {("train", "train"): 1, ("test", "test"): 1, ("train", "missing"): 1}


def test_partitions_keep_groups_whole(spark):
    g = groups_of(spark, n=6)
    for out in (partitions.grouped_iid(g, 3, 17), partitions.grouped_dirichlet(g, 3, 0.5, 17)):
        rows = out.collect()
        assert len(rows) == 12 and len({r["group_id"] for r in rows}) == 12
        assert sorted(rows) == sorted(out.collect())
    loads = partitions.grouped_iid(g, 3, 17).groupBy("client").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in loads} == {8}


def test_heterogeneity(spark):
    df = spark.createDataFrame([(0, "A"), (0, "A"), (0, "B"), (1, "B")], "client int, c string")
    h = {r["class_name"]: r for r in partitions.heterogeneity(partitions.class_client_grid(df, "c", "client")).collect()}
    assert h["A"]["monopoly"] == 1.0 and h["A"]["clients_with_samples"] == 1 and h["B"]["normalized_entropy"] == pytest.approx(1.0)


def test_hamming_and_hashes(spark):
    df = spark.createDataFrame([(v, "c", v) for v in (0b0000, 0b0011, 0b1111, 0b0001)], "path long, cls string, h long")
    got = {(r["left_path"], r["right_path"]): r["distance"] for r in similarity.hamming_pairs(df, "path", "cls", "h", 1).collect()}
    assert got == {(0, 1): 1, (1, 3): 1}
    rng = np.random.default_rng(0)
    vals = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    vals += [v ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for v in vals[:30]]
    df = spark.createDataFrame([(i, "c", v) for i, v in enumerate(vals)], "path long, cls string, h long")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if bin((vals[i] ^ vals[j]) & (2**64 - 1)).count("1") <= 8}
    assert {(r["left_path"], r["right_path"]) for r in similarity.hamming_pairs(df, "path", "cls", "h", 8).collect()} == want
    pix = [int(x) for x in rng.integers(0, 256, 72)]
    bits = 0
    for r in range(8):
        for c in range(8):
            bits = bits << 1 | (pix[r * 9 + c] > pix[r * 9 + c + 1])
    got = spark.createDataFrame([(pix,)], "p array<int>").select(S.dhash(F.col("p")).alias("h")).first()["h"]
    assert got & (2**64 - 1) == bits
    assert similarity.quantiles(df.limit(0), "h").first()["median"] is None


def test_inference(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 3, 4, 5)], "k string, d double")
    assert inference.sign_flip_p(df, ["k"], "d").first()["p"] == pytest.approx(0.0625)
    assert inference.wilcoxon_p(df, ["k"], "d").first()["p"] == pytest.approx(0.0625)
    assert inference.wilcoxon_p(df.withColumn("d", F.lit(0.0)), ["k"], "d").first()["p"] == 1.0
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, id string, p double")
    got = {r["id"]: r["holm_p"] for r in inference.holm(p, "f", "p", "id").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_intervals_take_all_resamples(spark, monkeypatch):
    """The registered intervals over 10,000 resamples, on small rows, against a plain bootstrap with the same draws."""
    from larkspur.plans import registry

    n = 5
    draws = [[int(hashlib.sha256(f"20260824:{rep}:{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)] for rep in range(10_000)]
    diff = [0.3, -0.1, 0.25, 0.7, 0.05]
    monkeypatch.setattr(registry, "diffs", lambda spark, d: spark.createDataFrame([("a", v) for v in diff], "alpha string, diff double"))
    got = registry.QUERIES["bootstrap_ci_whole"](spark, "").first()
    want = np.percentile([np.mean([sorted(diff)[i] for i in x]) for x in draws], [2.5, 97.5])
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(want), abs=2e-6)
    rows = [("a", s, k % 2, ((s * 7 + k * 3) % 11) / 10 + 0.3 * (k % 2) * (s % 3)) for s in range(n) for k in range(4)]
    monkeypatch.setattr(registry, "runs", lambda spark, d: spark.createDataFrame(rows, "alpha string, seed int, arm int, value double"))
    got = registry.QUERIES["clustered_spearman_ci_whole"](spark, "").first()
    rho = {}
    for x in {tuple(sorted(x)) for x in draws}:
        took = [r for s in x for r in rows if r[1] == s]
        rho[x] = np.corrcoef(ranks([r[3] for r in took]), ranks([r[2] for r in took]))[0, 1]
    want = np.percentile([rho[tuple(sorted(x))] for x in draws], [2.5, 97.5])
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(want), abs=2e-6)


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(i % 5)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, g int")
    f = models.ols(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose(f["estimate"], want) and max(f["p"][1:]) < 1e-20
    assert models.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    # against the dense REML criterion
    g = spark.createDataFrame([(float(rng.normal()), float(v), int(s), int(c)) for s in range(5) for c in range(6) for v in rng.normal(s * 0.5 - c * 0.3, 1, 3)], "x double, y double, s int, c int")
    m = models.crossed_lmm(g, ["x"], "y", ["s", "c"])
    p = g.toPandas()
    big_x = np.c_[np.ones(len(p)), p["x"]]

    def reml(vs, vc, e):
        v = vs * (p["s"].values[:, None] == p["s"].values) + vc * (p["c"].values[:, None] == p["c"].values) + e * np.eye(len(p))
        w = np.linalg.inv(v)
        a = big_x.T @ w @ big_x
        r = p["y"].values - big_x @ np.linalg.solve(a, big_x.T @ w @ p["y"].values)
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + r @ w @ r

    best = (m["variance"]["s"], m["variance"]["c"], m["residual"])
    for f in (0.9, 1.1):
        for k in range(3):
            near = [v * (f if i == k else 1) for i, v in enumerate(best)]
            assert reml(*best) <= reml(*near) + 1e-6
    k = spark.createDataFrame([(float(a), float(b > 0), 1.0, int(i % 5)) for i, (a, b) in enumerate(zip(x[:, 0], x[:, 0] + rng.normal(size=200), strict=True))], "x double, k double, n double, g int")
    f = models.logistic_gee(k, ["x"], "k", "n", "g")
    q = k.toPandas()
    mu = 1 / (1 + np.exp(-(f["estimate"][0] + f["estimate"][1] * q["x"])))
    assert abs((q["k"] - mu).sum()) < 1e-6 and abs(((q["k"] - mu) * q["x"]).sum()) < 1e-6


def test_accounting(spark):
    s = spark.createDataFrame([(10, 1.0, 1e-5), (10, 0.0, 1e-5)], "steps int, noise double, delta double")
    got = {r["noise"]: r for r in accounting.tightest_epsilon(s).collect()}
    want = min(10 * a / 2 + math.log(1e5) / (a - 1) for a in S.RENYI_ORDERS)
    assert got[1.0]["epsilon"] == pytest.approx(want) and got[0.0]["epsilon"] == float("inf")
    assert accounting.job_matrix(spark, a=[1, 2, 3], b=[1, 2, 3, 4, 5], c=["x", "y"]).count() == 30


def test_scalars(spark):
    row = spark.createDataFrame([("x___ RS_HL 100 ", "a, ,b", [1.0, 3.0, 3.0], ["A:::1", "B:::2"], 2.5)], "stem string, l string, v array<double>, c array<string>, h double").select(
        S.original_stem(F.col("stem")).alias("stem"), S.comma_list(F.col("l")).alias("l"), S.argmax(F.col("v")).alias("m"), S.leaf_of(F.col("c"), ["A"]).alias("leaf"), S.n_correct(F.lit(0.5), F.lit(5)).alias("n"), S.finite(F.lit(float("nan"))).alias("nan")
    ).first()
    assert tuple(row) == ("rs_hl 100", ["a", "b"], 1, "A:::1", 2, None)


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "img" / "cat").mkdir(parents=True)
    (tmp_path / "img" / "cat" / "a.JPG").write_bytes(b"x")
    (tmp_path / "img" / "cat" / "b.txt").write_bytes(b"y")
    assert [r["raw_class"] for r in manifests.images(spark, str(tmp_path / "img")).collect()] == ["cat"]
    ok = {"seed": 1, "label_flip": {"source_class": "a", "target_class": "b", "fraction": 0.5}}
    (tmp_path / "ok.json").write_text(json.dumps(ok))
    assert manifests.attack_config(spark, str(tmp_path / "ok.json")).first()["label_flip"]["fraction"] == 0.5
    for bad in (ok | {"other": 1}, {"seed": 1}, {"label_flip": {"source_class": "a", "target_class": "a", "fraction": 0.5}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            manifests.attack_config(spark, str(tmp_path / "bad.json"))
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"experiment_id": e, "round": r, "phase": "evaluate", "num_clients": 5, "num_failures": 0}) for e, n in (("a", 3), ("b", 2)) for r in range(1, n + 1)))
    q = rounds.progress(rounds.log(spark, str(log)), 3).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {r["experiment_id"]: r["complete"] for r in spark.sql("select * from progress").collect()} == {"a": True, "b": False}


def test_federated_rounds_learn(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 5), int(y), [float(v) for v in rng.normal(size=4) + 3 * np.eye(4)[y]]) for i, y in enumerate(rng.integers(0, 4, 200))]
    df = spark.createDataFrame(rows, "client long, label int, x array<double>")
    for agg in ("fedavg", "multikrum", "fedmedian", "trimmed_mean"):
        h = federated.run_rounds(df, 4, 4, 5, 3, agg)
        assert h[-1]["accuracy_before"] > 0.85


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_registered_loop_runs_all_rounds(spark):
    from larkspur.plans import registry

    assert sorted(r["round"] for r in registry.QUERIES["federated_loop"](spark, "/root/testdata/sf0.001").collect()) == list(range(1, 11))


def test_phash(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 256, 1024).astype(float).tolist()) for k in range(4)] + [(4, [7.0] * 1024)]
    i = np.arange(32)
    basis = np.array([math.sqrt((1 if u == 0 else 2) / 32) * np.cos(math.pi * (2 * i + 1) * u / 64) for u in range(8)])
    got = {r["k"]: r["h"] for r in spark.createDataFrame(rows, "k int, p array<double>").select("k", S.phash(F.col("p")).alias("h")).collect()}
    for k, p in rows[:4]:
        c = (basis @ np.array(p).reshape(32, 32) @ basis.T).ravel()
        assert got[k] & (2**64 - 1) == int("".join("1" if x > np.median(c[1:]) else "0" for x in c), 2)
    assert got[4] < 0  # of a flat picture the first coefficient alone is surely above


def test_validation_needs_every_client(spark):
    df = spark.createDataFrame([(0, "a", 3, 4), (1, "a", 1, 4), (1, "b", 2, 2)], "client int, class_name string, correct long, total long")
    got = {r["class_name"]: (r["correct"], r["total"], r["accuracy"]) for r in evaluation.validation_totals(df).collect()}
    assert got == {"a": (4, 8, 0.6), "b": (2, 2, 0.6)}
    lacking = df.unionByName(spark.createDataFrame([(2, None, None, None)], df.schema))
    assert evaluation.validation_totals(lacking).count() == 0


def test_candidate_report(spark):
    pairs = spark.createDataFrame([("c", "a", "b", 3, 9), ("c", "a", "d", 1, 2), ("c", "b", "d", 3, 9)], "class_name string, left_path string, right_path string, p int, d int")
    assert {r["bucket"]: r["n"] for r in similarity.two_hash_histogram(pairs, "p", "d").collect()} == {"p03_d09": 2, "p01_d02": 1}
    assert [r["p"] for r in similarity.reported(pairs, 2, ["class_name", "left_path", "right_path"], ["p", "d"]).collect()] == [1, 3]


def test_documents_of_the_protocol(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"a-b": {"a01": {"101": 3, "211": 0}}, "c-d": {"iid": {"101": 4}}}))
    got = {tuple(r) for r in manifests.attacker_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {("a-b", "a01", 101, 3), ("a-b", "a01", 211, 0), ("c-d", "iid", 101, 4)}
    assert manifests.layout(spark, str(tmp_path)) == "flat"
    (tmp_path / "train").mkdir()
    (tmp_path / "val").mkdir()
    assert manifests.layout(spark, str(tmp_path)) == "pre-split"
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "x string")
    assert manifests.index_list(one("[1, 4]", "[1,4]"), "x") == [1, 4]
    for bad in (("[1]", "[2]"), ("[]",), ("[1]", None), ("what",)):
        with pytest.raises(ValueError):
            manifests.index_list(one(*bad), "x")


def test_report_has_no_infinite_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1.5, [float("nan"), 2.0], {"k": float("inf")}, (float("-inf"), "x"))], "a double, b array<double>, c map<string,double>, d struct<e:double,f:string>")
    manifests.write_report(df, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert json.loads(text) == {"a": 1.5, "b": [None, 2.0], "c": {"k": None}, "d": {"e": None, "f": "x"}}


def test_dataset_id_and_gate(spark):
    df = spark.createDataFrame([("A", "g1", "p1", "h1", "train"), ("B", "g2", "p2", "h2", "test")], "class_name string, group_id string, path string, sha256 string, split string")
    r = curation.dataset_id(df, "capped").first()
    rows = [dict(zip(df.columns, x, strict=True)) for x in df.orderBy("path").collect()]
    digest = hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (r["digest"], r["dataset_id"]) == (digest, f"pv2-capped-{digest[:12]}")
    assert curation.audit_gate(df.limit(0), True) and not curation.audit_gate(df, True) and not curation.audit_gate(df.limit(0), False)


def test_flips_are_gated_and_nested():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), np.arange(40) % 4
    changed = lambda f, r: set(np.flatnonzero(f.applied(y, x, r) != y))
    half, tenth = federated.Flip(1, 2, 0.5, 2, 3), federated.Flip(1, 2, 0.1, 2)
    assert not changed(half, 1) and not changed(half, 4) and len(changed(half, 2)) == 5 and changed(half, 2) == changed(half, 3)
    assert len(changed(tenth, 9)) == 1 and changed(tenth, 9) < changed(half, 2)
    assert changed(federated.Flip(1, 2), 1) == set(np.flatnonzero(y == 1)) and not changed(federated.Flip(7, 2), 1)


def test_private_rounds_and_evaluation(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 5), int(y), [float(v) for v in rng.normal(size=4) + 3 * np.eye(4)[y]]) for i, y in enumerate(rng.integers(0, 4, 100))]
    df = spark.createDataFrame(rows, "client long, label int, x array<double>")
    clipped = federated.run_rounds(df, 4, 4, 5, 1, clip=0.1)[-1]
    assert 0 < clipped["norm"] <= 0.1 + 1e-9
    noisy = federated.run_rounds(df, 4, 4, 5, 1, clip=0.1, noise=1.0, seed=3)[-1]["weights"]
    assert np.allclose(noisy - clipped["weights"], np.random.default_rng([3, 1]).normal(0, 0.1 / 5, 20).reshape(5, 4))
    got = federated.evaluate(df, clipped["weights"]).collect()
    z = federated.logits(np.array([r[2] for r in rows]), clipped["weights"])
    y = np.array([r[1] for r in rows])
    assert sum(r["n"] for r in got) == 100 and sum(r["n"] for r in got if r["label"] == r["predicted"]) == (z.argmax(1) == y).sum()
    assert sum(r["loss"] for r in got) == pytest.approx(-np.log((np.exp(z) / np.exp(z).sum(1, keepdims=True))[np.arange(100), y]).sum())
    with pytest.raises(ValueError, match="of 6 clients"):
        federated.run_rounds(df, 4, 4, 6, 1)


def test_settings():
    assert protocol.checked_settings("fedavg", 5) == 5 and protocol.checked_settings("krum", 5, 1) == 1
    for bad in ({"aggregator": "krum", "clients": 4}, {"aggregator": "multikrum", "clients": 6, "byzantine": 2}, {"eval_clients": 6}, {"trim": 0.5}, {"noise": -1.0}, {"clip": 0.0}, {"delta": 1.0}, {"clip_only": True, "noise": 1.0}, {"aggregator": "fedmedian", "noise": 1.0}):
        with pytest.raises(ValueError):
            protocol.checked_settings(**{"aggregator": "fedavg", "clients": 5} | bad)


def test_classes_and_leaves(spark):
    renames, aliases = {"A_x": "A", "B_x": "B", "B_y": "B"}, {"B": ["B_z"]}
    assert protocol.source_names(renames, aliases) == {"A": ["A_x"], "B": ["B_z"]}
    with pytest.raises(ValueError):
        protocol.source_names(renames, aliases, ["C"])
    records = spark.createDataFrame([("p1", "rs 1", "A"), ("p2", "rs 1", "B"), ("p3", "rs 2", "A"), ("p4", None, "A")], "path string, stem string, raw string")
    leaves = spark.createDataFrame([("rs 1", "A:::1"), ("rs 1", "Bee:::2"), ("rs 2", "Bee:::3"), ("rs 2", "A")], "stem string, leaf string")
    prefixes = spark.createDataFrame([("B", "Bee")], "class_name string, prefix string")
    got = {r["path"]: r["leaf_id"] for r in protocol.with_leaf(records, "stem", "raw", leaves, prefixes).collect()}
    assert got == {"p1": "A:::1", "p2": "Bee:::2", "p3": None, "p4": None}
    with pytest.raises(Exception, match="several leaves"):
        protocol.with_leaf(records, "stem", "raw", leaves.unionByName(spark.createDataFrame([("rs 1", "A:::9")], leaves.schema))).collect()
    with pytest.raises(Exception, match="several leaves"):
        spark.range(1).select(S.leaf_of(F.array(F.lit("A:::1"), F.lit("A:::2")), ["A"])).collect()
    files = spark.createDataFrame([("A", "x\\1.jpg"), ("Z", "x\\2.jpg")], "class_name string, path string")
    assert [tuple(r) for r in protocol.class_samples(files, spark.createDataFrame([("A", 0), ("B", 1)], "class_name string, label int")).collect()] == [("A", 0, "x/1.jpg")]


def test_split_maps_refuse_conflicts(spark):
    schema = "path string, sha256 string, group_id string, leaf_id string, split string"
    good = [("a", "s1", "g1", None, "train"), ("b", "s1", "g1", "l1", "train"), ("c", "s2", "g2", "l2", "test")]
    assert protocol.split_maps(spark.createDataFrame(good, schema)).count() == 3 + 2 + 2 + 2
    assert protocol.split_maps(spark.createDataFrame([], schema)).count() == 0
    for bad in (("a", "s9", "g9", None, "train"), ("d", "s1", "g9", None, "test"), ("d", "s9", "g1", None, "test"), ("d", "s9", "g9", "l1", "test")):
        with pytest.raises(Exception, match="conflict of"):
            protocol.split_maps(spark.createDataFrame([*good, bad], schema)).collect()


def test_guards_and_small_parts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "a int, b string")
    assert protocol.one_value(df, "a") == 1 and protocol.first_matching(df, F.col("b") > "x", "b")["b"] == "y"
    for call in (lambda: protocol.one_value(df, "b"), lambda: protocol.one_value(df.limit(0), "a"), lambda: protocol.first_matching(df, F.col("a") > 1, "b")):
        with pytest.raises((ValueError, LookupError)):
            call()
    with pytest.raises(Exception, match="parts differ"):
        spark.range(1).select(inference.agreed(F.lit(1.0), F.lit(1.1), 1e-9, "parts differ")).collect()
    v = spark.createDataFrame([([[1, 2], [3], []],)], "t array<array<int>>")
    r = v.select(protocol.split_back(F.flatten("t"), F.transform("t", lambda x: F.size(x))).alias("t"), protocol.subset(F.array(F.lit(1)), F.flatten("t")).alias("s"), protocol.attack_types(F.lit(3), F.lit(2), F.lit(None).cast("int"), F.lit(True), F.lit(True)).alias("on"), protocol.attack_types(F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(True), F.lit(True)).alias("off")).first()
    assert tuple(r) == ([[1, 2], [3], []], True, ["label_flip", "model_update"], [])
    audit = protocol.client_audit(spark.createDataFrame([("10", float("inf"), 3, "no"), ("2", 0.5, 4, "no")], "client_id string, train_loss double, num_examples int, secret string"))
    assert audit.columns == ["client_id", "train_loss", "num_examples"] and [tuple(r) for r in audit.collect()] == [("10", None, 3), ("2", 0.5, 4)]


def test_hash_ranks_keep_null_classes(spark):
    df = spark.createDataFrame([(k, None if k % 3 == 0 else "a") for k in range(60)], "k int, c string")
    got = partitions.round_robin(df, "c", "k", 4, 1)
    assert {(r["c"], r["client"]): r["count"] for r in got.groupBy("c", "client").count().collect()} == {(c, i): n for c, n in ((None, 5), ("a", 10)) for i in range(4)}


@pytest.mark.parametrize("radius", [0, 1, 8, 9, 10, 20])
def test_hamming_join_equals_all_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 6)]
    near = []
    for h in base:
        for flips in (0, radius // 2, radius, radius + 1):
            mask = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            x = (h & (2**64 - 1)) ^ mask
            near.append(x - 2**64 if x >> 63 else x)
    rows = [(f"{i:03d}", "c" if i % 5 else "d", h) for i, h in enumerate(base + near)]
    got = {(r["left_path"], r["right_path"], r["distance"]) for r in similarity.hamming_pairs(spark.createDataFrame(rows, "p string, c string, h long"), "p", "c", "h", radius).collect()}
    want = {(a[0], b[0], d) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (d := ((a[2] ^ b[2]) & (2**64 - 1)).bit_count()) <= radius}
    assert got == want and want
