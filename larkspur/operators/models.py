"""Regressions whose sums come from Spark and whose small systems numpy solves on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def t_two_sided(t: float, df: float) -> float:
    """Student's tail by the regularised incomplete beta function (continued fraction)."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def t_quantile(q: float, df: float) -> float:
    """Student's quantile above the median, by halving."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < q else (low, mid)
    return high


def moments(df: DataFrame, xs: list[str], y: str, by: list[str] = ()) -> list:
    """Sums of all products of 1, xs and y, for each value of by: one pass, a row for each group."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    aggs = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*by).agg(*aggs).collect() if by else df.agg(*aggs).collect()


def matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    return m


def ols(df: DataFrame, xs: list[str], y: str) -> dict:
    """Estimates with standard errors, t tests, r2 and adjusted r2."""
    m = matrix(moments(df, xs, y)[0], len(xs) + 2)
    k, n = len(xs) + 1, m[0, 0]
    inv = np.linalg.pinv(m[:k, :k])
    beta = inv @ m[:k, k]
    sse = float(m[k, k] - beta @ m[:k, k])
    sst = float(m[k, k] - m[0, k] ** 2 / n)
    se = np.sqrt(np.maximum(np.diag(inv) * sse / (n - k), 0))
    return {"names": ["intercept", *xs], "estimate": beta, "se": se, "p": [t_two_sided(b / s, n - k) if s > 0 else float("nan") for b, s in zip(beta, se, strict=True)], "r2": 1 - sse / sst, "adj_r2": 1 - (sse / (n - k)) / (sst / (n - 1)), "n": int(n)}


def logistic_gee(df: DataFrame, xs: list[str], successes: str, trials: str, cluster: str, steps: int = 25) -> dict:
    """Binomial GEE, independent working correlation: weighted logistic Newton steps, each one aggregation, and cluster-robust errors."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(cols)
    beta = np.zeros(k)

    def sums(beta: np.ndarray, by: list[str]) -> list:
        eta = sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        score = F.col(successes) - F.col(trials) * mu
        info = F.col(trials) * mu * (1 - mu)
        aggs = [F.sum(c * score).alias(f"s{i}") for i, c in enumerate(cols)] + [F.sum(cols[i] * cols[j] * info).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        return df.groupBy(*by).agg(*aggs).collect()

    for _ in range(steps):
        row = sums(beta, [])[0]
        step = np.linalg.solve(matrix(row, k) + 1e-12 * np.eye(k), np.array([row[f"s{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    rows = sums(beta, [cluster])
    info = sum(matrix(r, k) for r in rows)
    meat = sum(np.outer(s, s) for s in (np.array([r[f"s{i}"] for i in range(k)]) for r in rows))
    inv = np.linalg.inv(info)
    return {"names": ["intercept", *xs], "estimate": beta, "robust_se": np.sqrt(np.diag(inv @ meat @ inv)), "clusters": len(rows)}


def crossed_lmm(df: DataFrame, xs: list[str], y: str, groups: list[str], large: str | None = None) -> dict:
    """Linear mixed model with crossed random intercepts by REML; a grouping of very many levels is given as large."""
    from larkspur.operators import mixed

    f = mixed.fit(df, xs, y, groups, large)
    c = f["coefficients"]
    return {"names": [r["term"] for r in c], "estimate": np.array([r["estimate"] for r in c]), "se": np.array([r["se"] for r in c]), "residual": f["residual"], "variance": f["variance"]}
