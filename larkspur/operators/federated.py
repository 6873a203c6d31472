"""Rounds of local training and aggregation of a softmax head."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import noise_stdv
from larkspur.operators import vectors
from larkspur.operators.protocol import checked_settings

#: Tasks get this module's functions themselves, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flip(NamedTuple):
    """An attacker's label flips: a fraction of the source class's samples, in rounds start to end (None: no end)."""

    source: int
    target: int
    fraction: float = 1.0
    start: int = 1
    end: int | None = None

    def applied(self, y: np.ndarray, x: np.ndarray, round_: int) -> np.ndarray:
        """The labels of a round. Which samples flip is set by a hash of their values, so it is the same in every round, and a smaller fraction's are among a larger one's."""
        own = np.flatnonzero(y == self.source)
        if round_ < self.start or self.end is not None and round_ > self.end or not len(own):
            return y
        order = sorted(own, key=lambda i: (hashlib.sha256(np.ascontiguousarray(x[i]).tobytes()).digest(), i))
        y = y.copy()
        y[order[: len(own) if self.fraction >= 1 else max(1, int(len(own) * self.fraction))]] = self.target
        return y


def local_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, steps: int, lr: float, mu: float) -> np.ndarray:
    """Full-batch gradient steps of cross-entropy plus mu / 2 of the squared distance to the global weights."""
    start, z = w.copy(), np.hstack([x, np.ones((len(x), 1))])
    hot = np.eye(classes)[y]
    for _ in range(steps):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w = w - lr * (z.T @ (p - hot) / len(z) + mu * (w - start))
    return w


AGGREGATORS = {"fedavg": lambda v, k: vectors.fedavg(v), "fedmedian": lambda v, k: vectors.coordinate_median(v), "trimmed_mean": vectors.trimmed_mean, "krum": vectors.krum, "multikrum": vectors.multikrum}


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))]) @ w


def trainer(w: np.ndarray, classes: int, steps: int, lr: float, mu: float, scale: dict[int, float], flip: dict[int, Flip], round_: int = 1, clip: float | None = None):
    """A client's round: flip labels where it attacks, fit, scale the update, clip its joint norm, and say how the weights it got do on its data."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["client"].iloc[0])
        x, y = np.array(pdf["x"].tolist()), pdf["label"].to_numpy()
        right = int((logits(x, w).argmax(1) == y).sum())
        if c in flip:
            y = flip[c].applied(y, x, round_)
        update = scale.get(c, 1.0) * (local_fit(x, y, w, classes, steps, lr, mu) - w)
        if not np.isfinite(update).all():
            raise ValueError(f"client {c} sends an update that isn't finite")
        if clip is not None:
            update *= min(1.0, clip / max(float(np.linalg.norm(update)), 1e-12))
        sent = w + update
        return pd.DataFrame({"client": c, "pos": np.arange(sent.size, dtype=np.int32), "w": sent.ravel(), "n": len(pdf), "correct": right})

    return fit


def evaluate(data: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per class and predicted class the samples and their summed cross-entropy: rows (label, predicted, n, loss)."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                z, y = logits(np.array(pdf["x"].tolist()), weights), pdf["label"].to_numpy()
                top = z.max(1)
                yield pd.DataFrame({"label": y, "predicted": z.argmax(1), "loss": np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]})

    each = data.select("label", "x").mapInPandas(score, "label int, predicted int, loss double")
    return each.groupBy("label", "predicted").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))


def run_rounds(data: DataFrame, classes: int, dim: int, clients: int, rounds: int, aggregator: str = "fedavg", steps: int = 20, lr: float = 0.5, mu: float = 0.0, scale: dict[int, float] | None = None, flip: dict[int, tuple] | None = None, clip: float | None = None, noise: float = 0.0, seed: int = 0) -> list[dict]:
    """data: (client, label, x array<double>). A client is one trainer with its own share of the data, so its share is one task's. Returns a history of rounds, the last with the weights. scale: update factors and flip: Flip's fields of attacking clients. With clip, updates are cut to that joint norm and the aggregate gets Gaussian noise of noise x clip / clients. A client without samples, or one that fails, ends the loop with an error, not with a smaller aggregate."""
    checked_settings(aggregator, clients, noise=noise, clip=1.0 if clip is None else clip, clip_only=clip is not None and noise == 0, mu=mu)
    if noise > 0 and clip is None:
        raise ValueError("noise needs a clipping norm")
    weights = np.zeros((dim + 1, classes))
    history: list[dict] = []
    scale, flips = scale or {}, {k: Flip(*v) for k, v in (flip or {}).items()}
    for r in range(1, rounds + 1):
        sent = data.groupBy("client").applyInPandas(trainer(weights, classes, steps, lr, mu, scale, flips, r, clip), "client long, pos int, w double, n long, correct long").persist()
        facts = sent.select("client", "n", "correct").distinct().collect()
        if len(facts) != clients:
            raise ValueError(f"{len(facts)} of {clients} clients took part in round {r}")
        agg = AGGREGATORS[aggregator](sent, clients).collect()  # a weight for each position: the model's size, not the data's
        weights = np.zeros((dim + 1) * classes)
        for row in agg:
            weights[row["pos"]] = row["w"]
        if noise > 0:
            weights += np.random.default_rng([seed, r]).normal(0.0, noise_stdv(noise, clip, clients), weights.size)
        weights = weights.reshape(dim + 1, classes)
        sent.unpersist()
        n = sum(f["n"] for f in facts)
        history.append({"round": r, "num_clients": len(facts), "accuracy_before": sum(f["correct"] for f in facts) / max(n, 1), "norm": float(np.linalg.norm(weights))})
    history[-1]["weights"] = weights
    return history
