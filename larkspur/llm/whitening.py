"""Whitening of embeddings by an exact scatter matrix in residue numbers.

Every entry c becomes the whole number x = floor(1024 c) + 100000. A first pass
sums the n vectors' x and finds their extremes, exactly. A second one centres
every vector, as n x - S in whole numbers, takes residues by several primes and
multiplies them modulo each prime, block by block, as matrices of doubles: a
block has so few rows that no sum of products leaves the 53 bits in which
doubles are exact. Partitions' residues are summed by Spark; Chinese remaindering
rebuilds each entry of the scatter, of which the primes' product is known to
exceed twice the largest possible. Its eigenvectors are taken in double
precision, and a last pass projects every vector.

Vectors that are null, or hold a null or an entry that isn't finite, are
dropped. Vectors of another length than most have (ties: the longer) are
dropped too, as they have no covariance with the rest; so are empty ones. A
null vec_id stays. Repeated rows count each. Entries beyond 2^61 / 1024 count as
that. Components whose eigenvalue is 0 to double precision can't be scaled to
unit variance and give no rows: one vector alone, or equal ones, give none.

The driver gets the d sums and the d (d + 1) / 2 entries of each prime, whatever
the number of rows; nothing is shuffled but these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import isqrt, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import plus, ready


@dataclass(frozen=True)
class Whitening:
    scale: int = 1024
    offset: int = 100_000
    components: int = 8
    below: int = 2**20
    """The primes are the largest below this."""


#: Entries are kept within this, so that whole numbers of 64 bits hold them.
FAR = 2**61


def primes(product: int, below: int) -> list[int]:
    """The largest primes below a number, as many as their product needs to exceed another."""
    out: list[int] = []
    p = below - 1
    while prod(out) <= product:
        if all(p % q for q in range(2, isqrt(p) + 1)):
            out.append(p)
        p -= 1
    return out


def remaindered(residues: list[int], mods: list[int]) -> int:
    """The whole number of least size with these residues."""
    whole = prod(mods)
    x = sum(r * (whole // m) * pow(whole // m, -1, m) for r, m in zip(residues, mods, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def _rows(batch: pa.RecordBatch, vector: str, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's usable vectors, and them as a matrix of doubles; without a dimension, their lengths."""
    column = batch[vector]
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without the entries of null lists
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)
    if flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(length)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (length > 0) & (wrong[ends] == wrong[ends - length])
    if dimension is None:
        return np.flatnonzero(good), length[good]
    at = np.flatnonzero(good & (length == dimension))
    return at, values[(ends[at] - dimension)[:, None] + np.arange(dimension)] if len(at) else np.zeros((0, dimension))


def whole_numbers(c: np.ndarray, p: Whitening) -> np.ndarray:
    return np.clip(np.floor(c * p.scale), -float(FAR), float(FAR)).astype(np.int64) + p.offset


def _totals(batches: Iterator[pa.RecordBatch], vector: str, p: Whitening) -> Iterator[pa.RecordBatch]:
    """A partition's number of vectors, sums and extremes, for each length that it has."""
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for batch in batches:
        for d in np.unique(_rows(batch, vector)[1]).tolist():
            x = whole_numbers(_rows(batch, vector, d)[1], p)
            # halves of 32 bits: sums of whole batches stay within 64
            part = [(int(h) << 32) + int(lo) for h, lo in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
            n[d] = n.get(d, 0) + len(x)
            sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), part, strict=True)]
            low[d] = np.minimum(low.get(d, x[0]), x.min(0))
            high[d] = np.maximum(high.get(d, x[0]), x.max(0))
    for d, k in n.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "pos": pa.array(range(d), pa.int32()), "n": pa.array([k] * d, pa.int64()), "s": pa.array([str(x) for x in sums[d]]), "low": pa.array(low[d]), "high": pa.array(high[d])})


def _residues(batches: Iterator[pa.RecordBatch], vector: str, p: Whitening, n: int, sums: list[int], mods: list[int]) -> Iterator[pa.RecordBatch]:
    """A partition's centred scatter modulo each prime, upper triangle."""
    d = len(sums)
    total = [np.zeros((d, d), np.int64) for _ in mods]
    block = 2**53 // max(mods) ** 2
    less = [np.array([s % m for s in sums], np.int64) for m in mods]
    for batch in batches:
        x = whole_numbers(_rows(batch, vector, d)[1], p)
        for at in range(0, len(x), block):
            for k, m in enumerate(mods):
                r = ((n % m * (x[at : at + block] % m) - less[k]) % m).astype(np.float64)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % m
    i, j = np.triu_indices(d)
    for m, t in zip(mods, total, strict=True):
        if t.any():
            yield pa.RecordBatch.from_pydict({"m": pa.array(np.full(len(i), m, np.int64)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "r": pa.array(t[i, j])})


@dataclass
class Whitener:
    """What one pass needs to whiten vectors; fit makes it."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    """Of n x - S, exact."""
    values: np.ndarray
    vectors: np.ndarray
    """A column for each component that can be scaled."""
    trace: float
    p: Whitening

    @cached_property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from whole numbers near S / n."""
        near = [s // self.n for s in self.sums]
        return (x - np.array(near, np.int64)) - np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, near, strict=True)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self._centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact: in 64 bits where that is proven to do, else in Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * most**2 < 2**63:
            v = self.n * x - np.array(self.sums, np.int64)
            return (v * v).sum(1).tolist()
        near = np.array([s // self.n for s in self.sums], np.int64)
        y, rest = x - near, [s - self.n * int(m) for s, m in zip(self.sums, near, strict=True)]
        most = self.n * int(np.abs(y).max(initial=0)) + self.n
        if len(self.sums) * most**2 < 2**63:
            v = self.n * y - np.array(rest, np.int64)
            return (v * v).sum(1).tolist()
        v = self.n * y.astype(object) - np.array(rest, object)
        return (v * v).sum(1).tolist()


def fit(df: DataFrame, vector: str = "embedding", p: Whitening = Whitening()) -> Whitener | None:
    """The whitener of all usable vectors; None without any."""
    ready(df.sparkSession, 4_000)
    only = df.select(vector)
    totals = only.mapInArrow(lambda it: _totals(it, vector, p), "d int, pos int, n long, s string, low long, high long")
    by = totals.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    most = by.filter("pos = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if not most:
        return None
    rows = by.filter(F.col("d") == most["d"]).orderBy("pos").collect()
    n, d, sums = most["n"], most["d"], [int(r["s"]) for r in rows]
    reach = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(rows, sums, strict=True))
    mods = primes(1 + 2 * n * reach * reach, p.below)
    parts = only.mapInArrow(lambda it: _residues(it, vector, p, n, sums, mods), "m long, i int, j int, r long")
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("m", "i", "j").agg(F.sum("r").alias("r")).collect():
        found.setdefault((r["i"], r["j"]), {})[r["m"]] = r["r"] % r["m"]
    scatter = [[0] * d for _ in range(d)]
    for (i, j), of in found.items():
        scatter[i][j] = scatter[j][i] = remaindered([of.get(m, 0) for m in mods], mods)
    v = np.array([[x / n**3 for x in row] for row in scatter])  # whole numbers divided: rounded once
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    keep = int((e[: p.components] > max(e[0], 0.0) * d * np.finfo(float).eps).sum())
    e, q = e[:keep], q[:, :keep]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(keep)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitener(n, sums, scatter, e, q, float(np.trace(v)), p)


def _moments(batches: Iterator[pa.RecordBatch], vector: str, w: Whitener) -> Iterator[pa.RecordBatch]:
    k = len(w.values)
    total = np.zeros((k, k))
    for batch in batches:
        z = w.whiten(whole_numbers(_rows(batch, vector, len(w.sums))[1], w.p))
        total += z.T @ z
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(total[i, j])})


def identity_error(df: DataFrame, w: Whitener, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance (their mean is 0 by construction) minus the identity, measured over all rows."""
    if not len(w.values):
        return 0.0
    rows = df.select(vector).mapInArrow(lambda it: _moments(it, vector, w), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r["v"] / w.n - (r["i"] == r["j"])) for r in rows)


def _whitened(batches: Iterator[pa.RecordBatch], vector: str, w: Whitener) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, c = _rows(batch, vector, len(w.sums))
        x = whole_numbers(c, w.p)
        kept = batch.take(pa.array(at))
        columns = {name: kept[name] for name in kept.schema.names}
        yield pa.RecordBatch.from_pydict(columns | {"_whitened": pa.array(list(w.whiten(x)), pa.list_(pa.float64())), "_deviation": pa.array([str(v) for v in w.deviation(x)], pa.string())})


def whiten(df: DataFrame, w: Whitener, vector: str = "embedding") -> DataFrame:
    """The usable rows of df with _whitened (an entry a component) and _deviation (a decimal number in digits, as it may leave 64 bits); columns of those names are replaced."""
    ready(df.sparkSession, 4_000)
    df = df.drop("_whitened", "_deviation")
    return df.mapInArrow(lambda it: _whitened(it, vector, w), plus(df, "_whitened array<double>, _deviation string"))
