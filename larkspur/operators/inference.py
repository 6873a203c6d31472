"""Exact paired tests, rank correlation, decompositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.scalars import sign12
from larkspur.operators.curation import cut


def paired(df: DataFrame, arm: str, value: str, left, right, keys: list[str]) -> DataFrame:
    """value of the left arm minus the right arm's, by keys; rows with both arms only."""
    one = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    return df.groupBy(*keys).agg((one(left) - one(right)).alias("diff")).filter("diff IS NOT NULL")


def seed_block_mean(df: DataFrame, seed: str, value: str, keys: list[str], balanced: bool = False) -> DataFrame:
    """Means within a seed first, then over seeds; jobs_mean is the plain mean. In a balanced design both are the same: then a difference above 1e-12 is an error."""
    block = df.groupBy(*keys, seed).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    out = block.groupBy(*keys).agg(F.avg("m").alias("mean"), F.count("*").alias("seeds"), (F.sum("s") / F.sum("c")).alias("jobs_mean"))
    return out.withColumn("mean", agreed(F.col("mean"), F.col("jobs_mean"), 1e-12, "the mean of seeds is not the mean of jobs")) if balanced else out


def mean_of_means(df: DataFrame, pair: str, value: str) -> DataFrame:
    """Each pair's mean and, as unweighted_pair_mean, the mean of those."""
    each = df.groupBy(F.col(pair).alias("pair")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return each.unionByName(each.agg(F.lit("unweighted_pair_mean").alias("pair"), F.sum("n").alias("n"), F.avg("mean").alias("mean")))


def _numbered(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, value, (F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1).alias("i"))


#: The differences that an exact test takes: 2 ** n sign patterns are made.
MOST_SIGNS = 22


def _masks(df: DataFrame, keys: list[str], term: F.Column) -> DataFrame:
    """Sums of term with the signs of every mask; a test's few differences make 2 ** n masks by its own definition."""
    n = df.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    n = n.withColumn("n", F.when(F.col("n") <= MOST_SIGNS, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"an exact test takes at most {MOST_SIGNS} differences, not "), F.col("n").cast("string"))).cast("int")))
    masks = n.withColumn("mask", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1L)")))
    sign = F.when(F.expr("shiftright(mask, i) & 1 = 1"), -1.0).otherwise(1.0)
    return masks.join(df, keys).groupBy(*keys, "mask").agg(F.sum(sign * term).alias("total"), F.first("n").alias("n"))


def sign_flip_p(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact two-sided permutation p over all sign patterns."""
    x = _numbered(df, keys, value)
    seen = x.groupBy(*keys).agg(F.avg(value).alias("mean"))
    all_ = _masks(x, keys, F.col(value)).join(seen, keys)
    hit = F.abs(F.col("total") / F.col("n")) + 1e-12 >= F.abs("mean")
    return all_.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg(hit.cast("double")).alias("p"))


def average_rank(value: F.Column, by: list[str], order: F.Column | None = None) -> F.Column:
    order = order if order is not None else value
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count("*").over(W.partitionBy(*by, order)) - 1) / 2.0


def ranked(df: DataFrame, keys: list[str], value: str, rank: str, weight: str | None = None) -> DataFrame:
    """df with average ranks of value within keys, however many rows a key has; a row with a weight counts as so many. Equal values are counted first; the counts are range-partitioned, and a value's rank is what stands before its partition, before it in its partition, and half of its own. Values must not be null."""
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    # borders are sampled anew by each job: what is summed twice must be the same partitions
    parts = cut(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))  # a row for each partition and key in it
    before = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_c").over(W.partitionBy("_part", *keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranks = parts.withColumn("_upto", inside).join(before, [*keys, "_part"]).select(*keys, F.col("_v").alias(value), (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(rank))
    return df.join(ranks, [*keys, value])


def wilcoxon_p(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Signed ranks, zeros dropped, exact two-sided p over all sign patterns; 1 where nothing is left."""
    x = df.select(*keys, F.col(value).alias("v")).filter(F.abs("v") > 1e-12)
    x = x.withColumn("r", average_rank(F.col("v"), keys, F.round(F.abs("v"), 12)))
    x = x.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("v")) - 1)
    seen = x.groupBy(*keys).agg(F.sum(F.signum("v") * F.col("r")).alias("w"))
    out = _masks(x, keys, F.col("r")).join(seen, keys).groupBy(*keys).agg(F.avg((F.abs("total") + 1e-9 >= F.abs("w")).cast("double")).alias("p"), F.first("w").alias("w"))
    return df.select(*keys).distinct().join(out, keys, "left").select(*keys, F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, standardised effect, sign counts, whether all share one sign."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.sum((v > 0).cast("long")).alias("n_positive"), F.sum((v < 0).cast("long")).alias("n_negative"),
        F.sum((F.abs(v) < 1e-15).cast("long")).alias("n_zero"), F.min(sign12(v)).alias("a"), F.max(sign12(v)).alias("b"),
    )
    dz = F.when(F.col("sd") > 1e-15, F.col("mean") / F.col("sd"))
    return out.select(*keys, "n", "mean", "sd", dz.alias("dz"), "n_positive", "n_negative", "n_zero", ((F.col("a") == F.col("b")) & (F.col("a") != 0)).alias("all_same_sign"))


def test_bundle(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return describe(df, keys, value).join(sign_flip_p(df, keys, value).select(*keys, F.col("p").alias("permutation_p")), keys).join(wilcoxon_p(df, keys, value).select(*keys, F.col("p").alias("wilcoxon_p")), keys)


def holm(df: DataFrame, family: str, p: str, id_: str) -> DataFrame:
    """Step-down adjusted p within each family, and whether it is below 0.05."""
    w = W.partitionBy(family).orderBy(p, id_)
    raw = (F.count("*").over(W.partitionBy(family)) - F.row_number().over(w) + 1) * F.col(p)
    out = df.withColumn("_raw", raw)
    adjusted = F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("holm_p", adjusted).withColumn("reject", F.col("holm_p") < 0.05).drop("_raw")


def family(df: DataFrame, id_: str, value: str, name: str = "all", intervals: bool = False) -> DataFrame:
    """A confirmatory family: the bundle of tests of each member's differences, with the exact p adjusted over the members (Holm); with intervals also boot_lo and boot_hi."""
    p = sign_flip_p(df, [id_], value).select(F.lit(name).alias("family"), id_, "p")
    return (test_row if intervals else test_bundle)(df, [id_], value).join(holm(p, "family", "p", id_).drop("p"), id_)


def seed_family(df: DataFrame, id_: str, seed: str, value: str) -> DataFrame:
    """A family whose unit is the seed: a member's jobs are averaged within each seed before its tests."""
    return family(df.groupBy(id_, seed).agg(F.avg(value).alias(value)), id_, value)


def agreed(a: F.Column, b: F.Column, tolerance: float, what: str) -> F.Column:
    """a, where b is the same within the tolerance; an error otherwise. Nulls pass."""
    return F.when(F.abs(a - b) > tolerance, F.raise_error(F.concat(F.lit(f"{what}: "), a.cast("string"), F.lit(" against "), b.cast("string"))).cast("double")).otherwise(a)


def against_reference(df: DataFrame, setting: str, reference, keys: list[str], value: str) -> DataFrame:
    """Each setting's value minus the reference setting's, by keys that have both; the reference itself gives no rows."""
    base = df.filter(F.col(setting) == reference).select(*keys, F.col(value).alias("_base"))
    return df.filter(F.col(setting) != reference).join(base, keys).select(setting, *keys, (F.col(value) - F.col("_base")).alias("diff"))


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, reps: int, seed: int) -> DataFrame:
    """95 % percentile interval of resampled means; the i-th draw of a repetition is picked by a SHA-256, so any engine draws the same."""
    x = _numbered(df, keys, value)
    n = x.groupBy(*keys).agg(F.count("*").alias("n"))
    draws = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("d", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "d"), 256), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.withColumn("i", pick).join(x, [*keys, "i"]).groupBy(*keys, "rep").agg(F.avg(value).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def seeded_means(df: DataFrame, keys: list[str], value: str, reps: int = 10_000, seed: int = 20260824) -> DataFrame:
    """(keys, lo, hi): 95 % percentile intervals of means over draws from a Mersenne Twister that each test seeds anew, as the original's are: equal to its to the last digit. The draws follow from the number of values alone; a test's values are few (MOST_SIGNS) and keep the order of `position` if df has it, else of their size."""
    order = "position" if "position" in df.columns else value
    few = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_values"))
    few = few.withColumn("_values", F.when(F.size("_values") <= MOST_SIGNS, F.col("_values")).otherwise(F.raise_error(F.lit(f"a test takes at most {MOST_SIGNS} values"))))

    @F.pandas_udf("struct<lo double, hi double>")
    def interval(values: pd.Series) -> pd.DataFrame:
        picks: dict[int, np.ndarray] = {}
        out = []
        for v in values:
            n = len(v)
            if n not in picks:
                rng = np.random.RandomState(seed)
                picks[n] = np.stack([rng.randint(0, n, size=n) for _ in range(reps)])
            out.append(np.percentile(v[picks[n]].mean(axis=1), [2.5, 97.5]))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return few.withColumn("_ci", interval("_values")).select(*keys, F.col("_ci.lo").alias("lo"), F.col("_ci.hi").alias("hi"))


#: The rows that a seeded interval of a correlation takes for a test: they are drawn again in one task.
MOST_ROWS = 100_000


def seeded_spearman(df: DataFrame, keys: list[str], cluster: str, x: str, y: str, reps: int = 10_000, seed: int = 20260824) -> DataFrame:
    """(keys, lo, hi): clustered_spearman_ci with the original's draws of clusters, taken in their order, from a Mersenne Twister that each test seeds anew. Draws without a correlation are left out; a test of none has null ends. A test has at most MOST_ROWS rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(cluster).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).cast("string").alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_rows"), F.count("*").alias("_n"))
    rows = rows.withColumn("_rows", F.when(F.col("_n") <= MOST_ROWS, F.col("_rows")).otherwise(F.raise_error(F.lit(f"a test takes at most {MOST_ROWS} rows"))))
    parts = rows.select(*keys, F.transform("_rows", lambda r: r["c"]).alias("c"), F.transform("_rows", lambda r: r["x"]).alias("x"), F.transform("_rows", lambda r: r["y"]).alias("y"))

    @F.pandas_udf("struct<lo double, hi double>")
    def interval(cs: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        def ranks(v: np.ndarray) -> np.ndarray:
            _, at, n = np.unique(v, return_inverse=True, return_counts=True)
            return (np.cumsum(n) - (n - 1) / 2)[at]

        out = []
        for c, x_, y_ in zip(cs, xs, ys, strict=True):
            names = sorted(set(c), key=lambda v: (0, float(v), "") if v.lstrip("-").isdigit() else (1, 0.0, v))
            at = [np.flatnonzero(np.asarray(c) == n) for n in names]
            rng, rho = np.random.RandomState(seed), []
            for _ in range(reps):
                take = np.concatenate([at[k] for k in rng.randint(0, len(names), size=len(names))])
                a, b = ranks(x_[take]), ranks(y_[take])
                a, b = a - a.mean(), b - b.mean()
                if a.any() and b.any():
                    rho.append(float((a @ b) / np.sqrt((a @ a) * (b @ b))))
            out.append(np.percentile(rho, [2.5, 97.5]) if rho else (None, None))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return parts.withColumn("_ci", interval("c", "x", "y")).select(*keys, F.col("_ci.lo").alias("lo"), F.col("_ci.hi").alias("hi"))


def test_row(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The whole bundle of a test: what test_bundle says, and the seeded interval as boot_lo and boot_hi."""
    ci = seeded_means(df, keys, value).select(*keys, F.col("lo").alias("boot_lo"), F.col("hi").alias("boot_hi"))
    return test_bundle(df, keys, value).join(ci, keys)


def _pair_ranks(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, _n, _rx, _ry) for each distinct pair of values; pairs with a null or NaN are left out."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = df.filter(ok(x) & ok(y)).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    return ranked(ranked(cut(pairs), keys, "_x", "_rx", "_n"), keys, "_y", "_ry", "_n")


def _correlated(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rho) from rows (keys, _n, _rx, _ry); null where a side doesn't vary."""
    s = lambda e: F.sum(F.expr(f"_n * {e}"))
    r = ranks.groupBy(*keys).agg(
        F.sum("_n").alias("n"), s("_rx").alias("sx"), s("_ry").alias("sy"), s("_rx * _ry").alias("sxy"), s("_rx * _rx").alias("sxx"), s("_ry * _ry").alias("syy"),
        ((F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))).alias("ok"),
    )
    rho = F.expr("(sxy - sx * sy / n) / sqrt(sxx - sx * sx / n) / sqrt(syy - sy * sy / n)")
    return r.select(*keys, "n", F.when(F.col("ok"), rho).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation within keys of any size; null where a side doesn't vary."""
    return _correlated(_pair_ranks(df, keys, x, y), keys)


def partial_spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Ranks over all rows, residuals from the groups' mean ranks, then Pearson: from each group's sums."""
    s = lambda e: F.sum(F.expr(f"_n * {e}"))
    d = df.select(F.col(by).alias("_g"), F.lit(1).alias("_one"), x, y)
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = cut(d.filter(ok(x) & ok(y)).groupBy("_one", "_g", F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n")))
    r = ranked(ranked(pairs, ["_one"], "_x", "_rx", "_n"), ["_one"], "_y", "_ry", "_n")
    g = r.groupBy("_g").agg(F.sum("_n").alias("n"), s("_rx").alias("sx"), s("_ry").alias("sy"), s("_rx * _ry").alias("sxy"), s("_rx * _rx").alias("sxx"), s("_ry * _ry").alias("syy"))
    inner = g.agg(F.sum("n").alias("n"), F.expr("sum(sxy - sx * sy / n)").alias("cxy"), F.expr("sum(sxx - sx * sx / n)").alias("cxx"), F.expr("sum(syy - sy * sy / n)").alias("cyy"))
    return inner.select("n", F.when((F.col("cxx") > 0) & (F.col("cyy") > 0), F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy")).alias("rho"))


def small_spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """spearman for very many groups that are each small, as resamples are: ranks in a window a group."""
    r = df.select(*keys, average_rank(F.col(x), keys).alias("_rx"), average_rank(F.col(y), keys).alias("_ry"), F.lit(1).alias("_n"))
    return _correlated(r, keys)


def simple_ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def loso_rmse(df: DataFrame, seed: str, x: str, y: str) -> DataFrame:
    """The root of the mean over seeds of the held-out mean squared error; each fit uses totals minus the seed's own sums."""
    c = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y)), "syy": F.sum(F.col(y) * F.col(y))}
    per = df.groupBy(seed).agg(*[v.cast("double").alias(k) for k, v in c.items()])
    total = per.agg(*[F.sum(k).alias(f"t_{k}") for k in c])
    r = per.crossJoin(F.broadcast(total)).select("*", *[(F.col(f"t_{k}") - F.col(k)).alias(f"r_{k}") for k in c])
    b = (F.col("r_n") * F.col("r_sxy") - F.col("r_sx") * F.col("r_sy")) / (F.col("r_n") * F.col("r_sxx") - F.col("r_sx") * F.col("r_sx"))
    r = r.withColumn("b", b).withColumn("a", (F.col("r_sy") - F.col("b") * F.col("r_sx")) / F.col("r_n"))
    sse = F.expr("syy - 2*a*sy - 2*b*sxy + n*a*a + 2*a*b*sx + b*b*sxx")
    return r.agg(F.sqrt(F.avg(sse / F.col("n"))).alias("rmse"), F.count("*").alias("seeds"))


def vif(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r")).select("r", (1.0 / (1.0 - F.col("r") * F.col("r"))).alias("vif"))


def accuracy_decomposition(df: DataFrame, keys: list[str], source: F.Column, accuracies: DataFrame | None = None) -> DataFrame:
    """Rows of classes with support, clean and attacked recall: the drop is the sum of share x recall loss; the source's part and the others'. accuracies (keys, clean_accuracy, attacked_accuracy), as evaluations have them, must differ by that drop within 1e-9: else recalls and accuracies aren't of the same runs, an error. Keys without accuracies give no rows then."""
    w = W.partitionBy(*keys)
    part = (F.col("support") / F.sum("support").over(w)) * (F.col("clean") - F.col("attacked"))
    out = df.withColumn("part", part).groupBy(*keys).agg(F.sum("part").alias("accuracy_drop"), F.sum(F.when(source, F.col("part")).otherwise(0.0)).alias("source_term"), F.sum(F.when(source, 0.0).otherwise(F.col("part"))).alias("collateral"))
    if accuracies is not None:
        seen = accuracies.select(*keys, (F.col("clean_accuracy") - F.col("attacked_accuracy")).alias("_seen"))
        out = out.join(seen, keys).withColumn("accuracy_drop", agreed(F.col("accuracy_drop"), F.col("_seen"), 1e-9, "the drop is not the accuracies' difference")).drop("_seen")
    return out


def aggregator_decomposition(df: DataFrame, keys: list[str]) -> DataFrame:
    """harm against the baseline aggregator = clean cost + own harm; columns baseline_clean, clean, attacked."""
    harm, cost, own = F.col("baseline_clean") - F.col("attacked"), F.col("baseline_clean") - F.col("clean"), F.col("clean") - F.col("attacked")
    return df.select(*keys, agreed(harm, cost + own, 1e-9, "harm is not the sum of its parts").alias("harm"), cost.alias("clean_cost"), own.alias("own_harm"))


def residual_spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """The diagnostic form: residuals of the values from their groups' means first, then ranks."""
    means = df.groupBy(by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    e = df.join(means, df[by].eqNullSafe(means[by])).select(F.lit(1).alias("_one"), F.round(F.col(x) - F.col("_mx"), 9).alias("ex"), F.round(F.col(y) - F.col("_my"), 9).alias("ey"))
    return spearman(e, ["_one"], "ex", "ey").select("n", "rho")


def clustered_spearman_ci(df: DataFrame, keys: list[str], cluster: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """95 % percentile interval of the rank correlation when whole clusters are drawn; repetitions without a correlation are left out."""
    c = df.select(*keys, cluster).distinct()
    c = c.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(cluster)) - 1)
    n = c.groupBy(*keys).agg(F.count("*").alias("n"))
    draws = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("d", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "d"), 256), 1, 8), 16, 10).cast("long") % F.col("n")
    rows = draws.withColumn("i", pick).join(c, [*keys, "i"]).select(*keys, "rep", cluster).join(df, [*keys, cluster])
    rho = small_spearman(rows, [*keys, "rep"], x, y).filter("rho IS NOT NULL")
    return rho.groupBy(*keys).agg(F.percentile("rho", F.lit(0.025)).alias("lo"), F.percentile("rho", F.lit(0.975)).alias("hi"))


def dose_frame(clean: DataFrame, attacked: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with every fraction that was tried, joined to the clean and the attacked value; combinations without both are left out."""
    return clean.withColumnRenamed("value", "clean").join(attacked.withColumnRenamed("value", "attacked"), keys).select(*keys, "fraction", "clean", "attacked", (F.col("clean") - F.col("attacked")).alias("harm"))
