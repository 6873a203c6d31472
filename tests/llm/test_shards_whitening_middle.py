"""Whitening, sharding and fill-in-the-middle against plain versions, and their edge cases."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import fill_middle, queries, sharding, whitening

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}{'.' if i % 11 == 0 else ''}" for i in range(40_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (2, ""), (3, "   \n\t"), (None, "a null id. " * 5), (None, None), (4, LONG), (5, LONG), (6, "x"), (6, "x"), (6, "y"), (7, "😀 漢字 ▁ \0 end."), (8, "a <P> b"), (9, "<S>"), (10, "<M"), (11, "S>x<P<P")]


# ------------------------------------------------------------ whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_whitening(rows):
    """x, n x - S and the covariance in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[k] for _, x in kept) for k in range(d)]
    y = [[n * x[k] - s[k] for k in range(d)] for _, x in kept]
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    return n, s, y, scatter


def random_vectors(n, d, seed=1, scale=1.0):
    g = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in row], 0) for i, row in enumerate(g.normal(size=(n, d)) * scale * np.arange(1, d + 1))]


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_scatter_is_exact_and_components_are_numpys(spark, scale):
    rows = random_vectors(300, 11, scale=scale)
    df = vectors(spark, rows).repartition(7)
    w = whitening.fit(df)
    n, s, y, scatter = plain_whitening(rows)
    assert (w.n, w.sums, w.scatter) == (n, s, scatter)
    v = np.array([[x / n**3 for x in r] for r in scatter])
    e, q = np.linalg.eigh(v)
    assert np.allclose(w.values, e[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs((w.vectors * q[:, ::-1][:, :8]).sum(0)), 1, atol=1e-9)
    assert math.isclose(w.explained[0], e[-1] / np.trace(v), rel_tol=1e-12)
    out = {r["vec_id"]: r for r in whitening.whiten(df, w).collect()}
    for (i, _, _), r in zip(rows, y, strict=True):
        assert int(out[i]["_deviation"]) == sum(x * x for x in r)
        assert np.allclose(out[i]["_whitened"], (np.array(r, float) / n) @ w.vectors / np.sqrt(w.values), atol=1e-9)
    assert whitening.identity_error(df, w) < 1e-9


def test_scatter_modulo_any_primes():
    assert whitening.primes(10**12, 100) == [97, 89, 83, 79, 73, 71, 67]
    mods = whitening.primes(2 * 10**30, 2**20)
    for x in (0, 1, -1, 10**30, -(10**30), 123456789012345678901234567890):
        assert whitening.remaindered([x % m for m in mods], mods) == x


def test_odd_vectors(spark):
    good = random_vectors(40, 4)
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [1.0, float("nan"), 2.0, 3.0], 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0, 2.0], 1)]
    twice = [(7, good[7][1], 9), (None, good[8][1], 9)]
    df = vectors(spark, [*odd, *good, *twice]).withColumn("_whitened", F.lit(7)).withColumn("d", F.lit("x"))
    w = whitening.fit(df)
    n, s, _, scatter = plain_whitening([*good, *twice])
    assert (w.n, w.sums, w.scatter) == (n, s, scatter) and n == 42
    out = whitening.whiten(df, w).collect()
    assert sorted(r["vec_id"] for r in out if r["vec_id"] is not None) == sorted([*range(40), 7])
    assert sum(r["vec_id"] is None for r in out) == 1
    assert all(len(r["_whitened"]) == 4 and r["d"] == "x" for r in out)
    same = [r["_whitened"] for r in out if r["vec_id"] == 7]
    assert same[0] == same[1]
    assert whitening.identity_error(df, w) < 1e-9


def test_vectors_without_variance(spark):
    assert whitening.fit(vectors(spark, [(1, None, 0)])) is None
    assert whitening.fit(vectors(spark, [])) is None
    w = whitening.fit(vectors(spark, [(i, [1.0, 2.0, 3.0], 0) for i in range(5)]))
    assert len(w.values) == 0
    line = vectors(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(50)])  # rank 1
    w = whitening.fit(line)
    assert len(w.values) == 1 and abs(w.explained[0] - 1) < 1e-12 and whitening.identity_error(line, w) < 1e-9


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [3e9 * (i % 3), -2e9 * i, 1.0], 0) for i in range(9)]
    df = vectors(spark, rows)
    rows = [(r["vec_id"], r["embedding"], 0) for r in df.collect()]
    n, _, y, _ = plain_whitening(rows)
    got = {r["vec_id"]: int(r["_deviation"]) for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert got == {i: sum(x * x for x in r) for (i, _, _), r in zip(rows, y, strict=True)}
    assert max(got.values()) > 2**63


@here
def test_whitening_query(spark):
    rows = queries.op11_embedding_whitening(spark, DATA).collect()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, s, y, scatter = plain_whitening([(r["vec_id"], r["embedding"], 0) for r in e])
    assert len(rows) == 8 * len(e) and {r["n"] for r in rows} == {n} and rows[0]["identity_error"] < 1e-6
    dev = {r["vec_id"]: sum(x * x for x in v) for r, v in zip(e, y, strict=True)}
    assert all(r["deviation"] == dev[r["vec_id"]] for r in rows)
    first = {c: np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == c]) for c in range(1, 9)}
    for a in first:
        for b in first:
            assert abs((first[a] * first[b]).mean() - (a == b)) < 1e-6


# ------------------------------------------------------------ sharding


def plain_shards(rows, k):
    """(doc_id, size, crc, shard, slot) by one sorted list."""
    r = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    whole, at, out, seen = sum(x[2] for x in r), 0, [], {}
    for known, i, size, crc in r:
        shard = (2 * at + size) * k // (2 * whole)
        out.append((i if known else None, size, crc, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
        at += size
    return out


def got_shards(df, k):
    return [tuple(r) for r in sharding.shard(df, sharding.Shards(k)).select("doc_id", "_size", "_crc32", "_shard", "_slot").collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("k", [1, 3, 8, 50])
def test_shards_equal_plain(spark, k):
    rows = [*ODD, *((i, "t" * (i * 7919 % 301)) for i in range(20, 400))]
    assert order(got_shards(docs(spark, rows).repartition(5), k)) == order(plain_shards(rows, k))


def test_one_id_with_many_rows_is_spread(spark):
    rows = [(3, "same text")] * 30_000 + [(i, f"other {i}") for i in range(30_000)]
    df = docs(spark, rows).repartition(6).drop("lang").withColumn("_shard", F.lit("x")).withColumn("_tie", F.lit(1))
    got = got_shards(df, 8)
    assert order(got) == order(plain_shards(rows, 8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small partitions stay
    parts = sharding.assign(df.select("doc_id", sharding.byte_size(F.col("text")).alias("s"), "_tie"), ["doc_id"], "s").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 0.5 * len(rows)


def test_no_rows(spark):
    assert got_shards(docs(spark, []), 8) == []


@here
def test_sharding_query(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in queries.op12_sharding(spark, DATA).collect()]
    assert order(got) == order(plain_shards([tuple(r) for r in d], 8))
    most = max(x[1] for x in got)
    sums = [sum(x[1] for x in got if x[3] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * most


# ------------------------------------------------------------ fill in the middle


def plain_middle(i, t):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def test_middle_equals_plain(spark):
    rows = [*ODD, *((i, f"<{i} S>P>M>" * (i % 9) + "ab c<" * (i % 5)) for i in range(100, 700)), *((i, LONG[: i * 13]) for i in range(50))]
    df = docs(spark, rows).withColumns({c: F.lit(7) for c in ("_units", "_output", "_restored", "_form", "_text", "_n")})
    out = fill_middle.restore(fill_middle.arrange(df)).collect()
    got = sorted(((r["doc_id"], r["text"], r["_units"], r["_form"], None if r["_prefix"] is None else len(r["_prefix"]), None if r["_middle"] is None else len(r["_middle"]), r["_output"]) for r in out), key=str)
    assert got == sorted(((i, t, *plain_middle(i, t)) for i, t in rows), key=str)
    assert all(r["_restored"] == (r["text"] or "") for r in out)
    assert {r["_form"] for r in out} == {"plain", "psm", "spm"}


def test_middle_is_native_and_takes_no_rows(spark):
    df = fill_middle.restore(fill_middle.arrange(docs(spark, ODD)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.replace("PythonRDD", ""))
    assert fill_middle.restore(fill_middle.arrange(docs(spark, []))).collect() == []


@here
def test_middle_query(spark):
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op13_fill_in_middle(spark, DATA).collect():
        n, form, x, y, out = plain_middle(r["doc_id"], d[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, x, y, hashlib.sha256(out.encode()).hexdigest())
        assert r["restored_sha256"] == hashlib.sha256(d[r["doc_id"]].encode()).hexdigest()
