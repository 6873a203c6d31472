"""Quality classifier: a regularised quadratic discriminant over statistics of a text.

The statistics are transformed (logarithms, logits) and standardised; each
class has its mean and a covariance shrunk first towards the pooled one, then
towards a multiple of the unit matrix. A score is a logistic function of the
difference of the two Gaussian log densities, from Mahalanobis distances by the
cached Cholesky factors; its two parameters are fitted on the same sample.

The model is fitted on a bounded sample of labelled rows; only their numbers
reach the driver. Nulls: a null text is an empty one. Texts of any length are
read whole. Without labels of both kinds every score is the labels' share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import plus, ready
from larkspur.llm.toxicity import labelled, logistic
from larkspur.llm.words import strings


@dataclass(frozen=True)
class QualityFit:
    train_rows: int = 20_000
    to_pooled: float = 0.2
    to_unit: float = 0.05
    threshold: float = 0.5


def _kinds() -> np.ndarray:
    """For each byte its kind: lower, upper, digit, white space, sentence mark, other mark, beyond ASCII."""
    kind = np.full(256, 6)
    kind[:128] = 5
    for x, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:?'\"-()")):
        kind[list(chars)] = x
    return kind


KINDS = _kinds()
ONE_HOT = np.eye(7)[KINDS]


def statistics(text: str) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    kind = hist @ ONE_HOT
    n = max(1, len(raw))
    words = text.split()
    m = max(1, len(words))
    lines = text.split("\n")
    unique = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    p = hist[hist > 0] / n
    logit = lambda x: float(np.log((x + 0.002) / (1.002 - min(1.0, x))))
    return [
        float(np.log1p(n)),
        float(np.log1p(n / m)),
        *(logit(k / n) for k in (kind[1], kind[2], kind[3], kind[4], kind[5], kind[6])),
        float(np.log((unique + 1) / (m**0.8 + 1))),
        logit(again / m),
        logit(1 - len(set(lines)) / len(lines)),
        float(np.log1p(m / len(lines))),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


WIDTH = len(statistics(""))


@dataclass
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centre: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    slope: float
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        density = [-0.5 * (((z - c) @ inv) ** 2).sum(1) - ld for c, inv, ld in zip(self.centre, self.inverse, self.log_det, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(m) + self.bias, -30, 30)))


def squash(m: np.ndarray) -> np.ndarray:
    """Far tails of the densities say no more than that they are far."""
    return np.sign(m) * np.log1p(np.abs(m))


def discriminant(x: np.ndarray, y: np.ndarray, p: QualityFit = QualityFit()) -> Discriminant:
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / scale
    centre = np.stack([z[y == k].mean(0) for k in (0, 1)])
    own = [(z[y == k] - centre[k]).T @ (z[y == k] - centre[k]) / max(1, (y == k).sum()) for k in (0, 1)]
    pooled = (z - centre[y.astype(int)]).T @ (z - centre[y.astype(int)]) / len(z)
    inverse, log_det = [], []
    for k in (0, 1):
        s = (1 - p.to_pooled) * own[k] + p.to_pooled * pooled
        s = (1 - p.to_unit) * s + p.to_unit * np.trace(s) / d * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor).T)
        log_det.append(float(np.log(np.diag(factor)).sum()))
    out = Discriminant(mean, scale, centre, np.stack(inverse), np.array(log_det), 1.0, 0.0)
    slope, bias = logistic(squash(out.margin(x))[:, None], y.astype(float))
    out.slope, out.bias = float(slope), float(bias)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"label": batch["label"], "x": pa.array([statistics(t) for t in strings(batch["text"])], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, p: QualityFit = QualityFit()) -> Discriminant:
    ready(docs.sparkSession)
    rows = labelled(docs, labels, "quality", p.train_rows).mapInArrow(_statistics, "label int, x array<double>").collect()
    return discriminant(np.array([r["x"] for r in rows], float).reshape(-1, WIDTH), np.array([int(r["label"] == 1) for r in rows]), p)


def _scores(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in strings(batch["text"])], float).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names} | {"_score": pa.array(model.score(x))})


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """docs with _score (0 to 1); a column of that name is replaced."""
    ready(docs.sparkSession)
    docs = docs.drop("_score")
    return docs.mapInArrow(lambda it: _scores(it, model), plus(docs, "_score double"))
