"""Linear mixed models with crossed random intercepts, by REML.

Groupings with few levels (seeds, classes) are columns of one small matrix; a
grouping with very many (jobs) never becomes one. With a variance ratio r, a
job of n rows takes r / (1 + r n) times the outer product of its column sums
from that matrix. So jobs of one size share a factor: Spark sums the outer
products for each size, once, and the driver can then evaluate any ratio
exactly, however many jobs there are. The profiled likelihood is minimised over
the ratios, which may be 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import formulas
from larkspur.operators.formulas import Term

#: Distinct sizes that a large grouping may have: each is a matrix on the driver.
MOST_SIZES = 2_000
NORMAL_975 = 1.959963984540054


def _cells(df: DataFrame, named: dict[str, Column], small: list[str], large: str | None) -> DataFrame:
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(named.values())], *[F.col(g).alias(f"g{i}") for i, g in enumerate(small)], *([F.col(large).alias("job")] if large else [])).dropna()


def _gram(cells: DataFrame, k: int, levels: list[list]) -> np.ndarray:
    """Products of all columns: the intercept and numbers, an indicator for each level, the outcome; from sums by cell of the small groupings."""
    cols = [F.lit(1.0), *(F.col(f"c{i}") for i in range(k))]
    rows = cells.groupBy(*[f"g{i}" for i in range(len(levels))]).agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).collect()
    y = k + sum(map(len, levels))
    at = [*range(k), y]
    full = np.zeros((y + 1, y + 1))
    offset = np.cumsum([k, *map(len, levels)])
    place = [{v: int(offset[g]) + i for i, v in enumerate(lv)} for g, lv in enumerate(levels)]
    for r in rows:
        m = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        full[np.ix_(at, at)] += m
        mine = [place[g][r[f"g{g}"]] for g in range(len(levels))]
        for a in mine:
            full[at, a] += m[:, 0]
            full[a, at] += m[:, 0]
            for b in mine:
                full[a, b] += m[0, 0]
    return full


def _by_size(cells: DataFrame, k: int, levels: list[list]) -> dict[int, tuple[int, np.ndarray]]:
    """For each size of a job: how many jobs have it, and the sum of the outer products of their column sums."""
    sums = [F.count("*").cast("double"), *(F.sum(f"c{i}") for i in range(k - 1)), *(F.sum((F.col(f"g{g}") == F.lit(v)).cast("double")) for g, lv in enumerate(levels) for v in lv), F.sum(f"c{k - 1}")]
    jobs = cells.groupBy("job").agg(F.count("*").alias("n"), F.array(*sums).alias("s"))
    width = k + sum(map(len, levels)) + 1

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            n = batch["n"].to_numpy(zero_copy_only=False)
            s = batch["s"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for size in np.unique(n).tolist():
                mine = s[n == size]
                count, total = found.get(size, (0, np.zeros((width, width))))
                found[size] = (count + len(mine), total + mine.T @ mine)
        i, j = np.triu_indices(width)
        for size, (count, total) in found.items():
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(i), size)), "c": pa.array(np.full(len(i), count)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(total[i, j])})

    if jobs.select("n").distinct().limit(MOST_SIZES + 1).count() > MOST_SIZES:
        raise ValueError(f"a large grouping has more than {MOST_SIZES} different sizes")
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in jobs.mapInArrow(outer, "n long, c long, i int, j int, v double").groupBy("n", "i", "j").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        m = out.setdefault(r["n"], (r["c"], np.zeros((width, width))))[1]
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return out


def _minimum(f, dims: int) -> tuple[np.ndarray, bool]:
    """The ratios (0 or positive) of least value: the best of a grid, then steps along each axis and along the last move, halved when none helps."""
    grid = [0.0, *np.exp(np.linspace(-9, 3, 9 if dims > 2 else 17))]
    best = min((f(np.array(x)), x) for x in product(grid, repeat=dims))
    value, ratio, step = best[0], np.array(best[1]), 1.0
    for _ in range(2_000):
        if step < 1e-7:
            return ratio, True
        before = ratio.copy()
        for g in range(dims):
            for by in (math.exp(step), math.exp(-step), 0.0):
                trial = ratio.copy()
                trial[g] = trial[g] * by if trial[g] else (1e-3 * step if by > 1 else 0.0)
                if (v := f(trial)) < value - 1e-13 * abs(value):
                    ratio, value = trial, v
        moved = not np.array_equal(before, ratio)
        if moved and np.all(before > 0) and np.all(ratio > 0):  # along the valley
            trial = ratio * (ratio / before)
            if (v := f(trial)) < value:
                ratio, value = trial, v
        step = step if moved else step / 2
    return ratio, False


def fit(df: DataFrame, terms: list[Term], y: str, small: list[str], large: str | None = None) -> dict:
    """Estimates, standard errors, normal p and intervals; variances by grouping; a ValueError where the fixed columns don't determine their coefficients. Rows with a null are left out. small groupings have at most formulas.MOST_LEVELS levels."""
    of = {c: formulas.levels(df, c) for t in terms for c in formulas.factors(t)}
    named: dict[str, Column] = {}
    for t in terms:
        named |= dict(formulas.columns(t, of))
    named[y] = F.col(y).cast("double")
    cells = _cells(df, named, small, large)
    levels = [formulas.levels(cells, f"g{i}") for i in range(len(small))]
    k = len(named)  # with the intercept, without y
    gram = _gram(cells, k, levels)
    sizes = _by_size(cells, k, levels) if large else {}
    n, q = gram[0, 0], sum(map(len, levels))
    if n <= k or np.linalg.matrix_rank(gram[:k, :k] / np.sqrt(np.outer(np.diag(gram)[:k], np.diag(gram)[:k])), hermitian=True) < k:
        raise ValueError("the fixed columns don't determine their coefficients")
    x, z, yy = list(range(k)), list(range(k, k + q)), k + q
    groupings = [*([large] if large else []), *small]

    def parts(ratio: np.ndarray):
        m, log_det, rest = gram, 0.0, ratio
        if large:
            r, rest = ratio[0], ratio[1:]
            m = gram - sum((r / (1 + r * size) * s for size, (_, s) in sizes.items()), np.zeros_like(gram))
            log_det = sum(c * math.log1p(r * size) for size, (c, _) in sizes.items())
        s = np.sqrt(np.concatenate([np.full(len(lv), r) for lv, r in zip(levels, rest, strict=True)] or [np.zeros(0)]))
        inner = np.eye(q) + s[:, None] * m[np.ix_(z, z)] * s
        w = np.linalg.solve(inner, s[:, None] * m[np.ix_(z, [*x, yy])]) if q else np.zeros((0, k + 1))
        left = m[np.ix_([*x, yy], [*x, yy])] - m[np.ix_([*x, yy], z)] @ (s[:, None] * w)
        beta = np.linalg.solve(left[:k, :k], left[:k, k])
        rss = float(left[k, k] - beta @ left[:k, k])
        value = log_det + (np.linalg.slogdet(inner)[1] if q else 0.0) + np.linalg.slogdet(left[:k, :k])[1] + (n - k) * math.log(max(rss, 1e-300))
        return value, beta, rss / (n - k), np.linalg.inv(left[:k, :k]), s, inner, m

    ratio, converged = _minimum(lambda r: float(parts(r)[0]), len(groupings))
    _, beta, sigma2, inverse, s, inner, m = parts(ratio)
    se = np.sqrt(np.diag(inverse) * sigma2)
    rows = [{"term": t, "estimate": float(b), "se": float(e), "p": math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None, "ci95": (float(b - NORMAL_975 * e), float(b + NORMAL_975 * e))} for t, b, e in zip(["intercept", *list(named)[:-1]], beta, se, strict=True)]
    effects = s * np.linalg.solve(inner, s * (m[z, yy] - m[np.ix_(z, x)] @ beta)) if q else np.zeros(0)
    return {
        "n": int(n), "converged": converged, "coefficients": rows, "residual": float(sigma2), "variance": {g: float(r * sigma2) for g, r in zip(groupings, ratio, strict=True)},
        "residuals": _residuals(cells, k, beta, levels, effects, float(ratio[0]) if large else None),
    }


def _residuals(cells: DataFrame, k: int, beta: np.ndarray, levels: list[list], effects: np.ndarray, large: float | None) -> dict:
    """What rows are from their fitted values, which hold the predicted effects."""
    fixed = sum((F.col(f"c{i}") * float(beta[i + 1]) for i in range(k - 1)), F.lit(float(beta[0])))
    at = 0
    for g, lv in enumerate(levels):
        each = F.lit(0.0)
        for v in lv:
            each = F.when(F.col(f"g{g}") == F.lit(v), float(effects[at])).otherwise(each)
            at += 1
        fixed = fixed + each
    out = cells.withColumn("_fitted", fixed).withColumn("_y", F.col(f"c{k - 1}"))
    if large is not None:
        own = out.groupBy("job").agg((F.lit(large) / (1 + F.lit(large) * F.count("*")) * F.sum(F.col("_y") - F.col("_fitted"))).alias("_own"))
        out = out.join(own, "job").withColumn("_fitted", F.col("_fitted") + F.col("_own"))
    e = F.col("_y") - F.col("_fitted")
    many = lambda c: F.sum(c.cast("long"))
    r = out.agg(F.count("*").alias("n"), F.avg(e).alias("resid_mean"), F.stddev_samp(e).alias("resid_sd"), F.min("_fitted").alias("fitted_min"), F.max("_fitted").alias("fitted_max"), many((F.col("_fitted") < 0) | (F.col("_fitted") > 1)).alias("n_fitted_outside_01"), many(F.col("_y") <= 1e-12).alias("n_obs_at_0"), many(F.col("_y") >= 1 - 1e-12).alias("n_obs_at_1"))
    return r.first().asDict()


def fit_or_fallback(df: DataFrame, terms: list[Term], y: str, small: list[str], large: str | None, fallback: str) -> dict:
    """fit; where it fails, the fit with the fallback grouping alone, with method and warning saying so; where that fails too, no coefficients."""
    said = " + ".join(f"(1|{g})" for g in [*([large] if large else []), *small])
    try:
        return fit(df, terms, y, small, large) | {"method": said, "warning": None}
    except (ValueError, np.linalg.LinAlgError) as e:
        warning = f"{said} failed: {e}"
    if [fallback] != small or large:
        try:
            return fit(df, terms, y, [fallback]) | {"method": f"fallback (1|{fallback})", "warning": warning}
        except (ValueError, np.linalg.LinAlgError) as e:
            warning += f" | (1|{fallback}) failed: {e}"
    return {"n": None, "converged": False, "coefficients": [], "residual": None, "variance": {}, "residuals": {}, "method": None, "warning": warning}


def term(result: dict, name: str) -> dict | None:
    return next((c for c in result["coefficients"] if c["term"] == name), None)
