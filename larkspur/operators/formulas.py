"""Linear models with factors and interactions, all fitted from one pass over the rows.

A term is a column's name (a number), `factor("x")` (an indicator for each level
but the first, in sorted order) or a tuple of those (their product). Models over
one frame share their columns, so one aggregation sums the products of all of
them for each value of a unit (a seed). A model takes its part of that matrix;
leaving a unit out subtracts its sums. The driver gets a matrix a unit, of as
many columns as the models have, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.models import t_quantile, t_two_sided

#: The levels that a factor may have: each becomes a column.
MOST_LEVELS = 64


@dataclass(frozen=True)
class factor:
    column: str


Term = str | factor | tuple


def levels(df: DataFrame, column: str) -> list:
    """A factor's levels in order; an error beyond MOST_LEVELS."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return found


def columns(term: Term, of: dict[str, list]) -> list[tuple[str, Column]]:
    if isinstance(term, str):
        return [(term, F.col(term).cast("double"))]
    if isinstance(term, factor):
        return [(f"{term.column}[{v}]", (F.col(term.column) == F.lit(v)).cast("double")) for v in of[term.column][1:]]
    out = [("", F.lit(1.0))]
    for part in term:
        out = [(f"{a}:{b}".lstrip(":"), x * y) for a, x in out for b, y in columns(part, of)]
    return out


def factors(term: Term) -> list[str]:
    return [term.column] if isinstance(term, factor) else [] if isinstance(term, str) else [c for t in term for c in factors(t)]


@dataclass
class Moments:
    """Sums of products of all columns (the intercept first, y last) for each unit; numbers are taken from their means, so that no sum swamps another."""

    units: list
    names: list[str]
    sums: np.ndarray
    """units x columns x columns."""
    of: dict[str, list]
    shift: np.ndarray

    def model(self, terms: list[Term]) -> tuple[list[str], np.ndarray]:
        """A model's term names and each unit's matrix of its columns, y last."""
        names = ["intercept", *(n for t in terms for n, _ in columns(t, self.of))]
        at = [0, *(self.names.index(n) for n in names[1:]), len(self.names) - 1]
        return names, self.sums[np.ix_(range(len(self.units)), at, at)]

    def shifted(self, names: list[str]) -> np.ndarray:
        return np.array([self.shift[self.names.index(n)] for n in names[1:]])


def moments(df: DataFrame, models: list[list[Term]], y: str, unit: str) -> Moments:
    """One aggregation of all models' columns by unit, after one of their means. Rows with a null in any column are left out, as they have no place in some model."""
    terms = list(dict.fromkeys(t for m in models for t in m))
    of = {c: levels(df, c) for t in terms for c in factors(t)}
    named: dict[str, Column] = {}
    for t in terms:
        named |= dict(columns(t, of))
    named[y] = F.col(y).cast("double")
    x = df.select(unit, *[c.alias(f"c{i}") for i, c in enumerate(named.values())]).dropna()
    k = len(named) + 1
    shift = np.array([0.0, *(v or 0.0 for v in x.agg(*[F.avg(f"c{i}") for i in range(k - 1)]).first())])
    cols = [F.lit(1.0), *(F.col(f"c{i}") - float(shift[i + 1]) for i in range(k - 1))]
    rows = x.groupBy(unit).agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).orderBy(unit).collect()
    sums = np.zeros((len(rows), k, k))
    for n, r in enumerate(rows):
        for i in range(k):
            for j in range(i, k):
                sums[n, i, j] = sums[n, j, i] = r[f"m{i}_{j}"]
    return Moments([r[unit] for r in rows], ["intercept", *named], sums, of, shift)


def ols(m: Moments, terms: list[Term]) -> dict:
    """n, r2, r2_adj and for each term its estimate, standard error, p and 95 % interval."""
    names, sums = m.model(terms)
    s, k = sums.sum(0), len(names)
    n = float(s[0, 0])
    inverse = np.linalg.pinv(s[:k, :k], hermitian=True)
    rank = int(np.linalg.matrix_rank(s[:k, :k], hermitian=True))
    beta = inverse @ s[:k, k]
    sse = max(0.0, float(s[k, k] - beta @ s[:k, k]))
    sst = float(s[k, k] - s[0, k] ** 2 / n)
    rest = n - rank
    # back from the means: the intercept is at 0 of every column
    back = np.eye(k)
    back[0, 1:] = -m.shifted(names)
    at0 = back @ beta
    at0[0] += m.shift[-1]
    se = np.sqrt(np.maximum(np.diag(back @ inverse @ back.T) * sse / rest, 0)) if rest > 0 else np.full(k, np.nan)
    reach = t_quantile(0.975, rest) if rest > 0 else float("nan")
    rows = [{"term": name, "estimate": float(b), "se": float(e), "p": t_two_sided(b / e, rest) if e > 0 else None, "ci95": (float(b - reach * e), float(b + reach * e))} for name, b, e in zip(names, at0, se, strict=True)]
    return {"n": int(n), "r2": float(1 - sse / sst) if sst else None, "r2_adj": float(1 - (sse / rest) / (sst / (n - 1))) if sst and rest > 0 else None, "coefficients": rows}


def leave_one_out(m: Moments, terms: list[Term]) -> dict:
    """The root of the mean over units of the mean squared error of a unit's rows under the fit of all others."""
    names, sums = m.model(terms)
    total, k = sums.sum(0), len(names)
    squares = []
    for own in sums:
        rest = total - own
        beta = np.linalg.pinv(rest[:k, :k], hermitian=True) @ rest[:k, k]
        squares.append(float(own[k, k] - 2 * beta @ own[:k, k] + beta @ own[:k, :k] @ beta) / own[0, 0])
    return {"n": int(total[0, 0]), "rmse": float(np.sqrt(max(0.0, float(np.mean(squares)))))}
