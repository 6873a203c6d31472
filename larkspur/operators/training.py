"""Mini-batch AdamW of a softmax head, for clients of any size.

Steps of one client follow each other by definition; what must not grow with a
client is the memory of its task. An epoch is one shuffle: every client's rows
meet in one task, its state first and its samples in the epoch's order, and
stream through it a batch at a time. The state (weights, both moments, the step)
is a row a client and comes out as one; it is written to the shared folder after
each epoch, so a lost executor repeats one epoch at most.

The order of an epoch is by a hash of the seed, the epoch and the sample's id: it
is another in each epoch and the same in each run. Ties of ids go by the sample
itself. Samples whose features or label are null are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.curation import cut

#: Tasks get this module's functions themselves, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "client long, w array<double>, m array<double>, v array<double>, step long, loss double, n long"


@dataclass(frozen=True)
class AdamW:
    """The optimiser; betas and eps are its usual ones. mu pulls towards the weights that the fit began with."""

    classes: int
    dim: int
    batch: int = 16
    lr: float = 1e-3
    weight_decay: float = 1e-4
    mu: float = 0.0
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    @property
    def size(self) -> int:
        return (self.dim + 1) * self.classes


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """The mean cross-entropy of a batch and its gradient; the last row of w is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    s = z @ w
    s -= s.max(1, keepdims=True)
    p = np.exp(s)
    total = p.sum(1, keepdims=True)
    loss = float((np.log(total[:, 0]) - s[np.arange(len(y)), y]).mean())
    return loss, z.T @ (p / total - np.eye(classes)[y]) / len(x)


def start(spark: SparkSession, clients: list[int], p: AdamW, weights: np.ndarray | None = None) -> DataFrame:
    """Each client's state before its first step."""
    w = np.zeros(p.size) if weights is None else np.asarray(weights, float).ravel()
    zero = [0.0] * p.size
    return spark.createDataFrame([(c, w.tolist(), zero, zero, 0, 0.0, 0) for c in clients], STATE)


def epoch(samples: DataFrame, states: DataFrame, p: AdamW, seed: int, number: int, anchors: dict[int, np.ndarray] | np.ndarray | None = None) -> DataFrame:
    """The clients' states after an epoch, with its mean loss and samples. samples: (client, id, x array<double>, label); anchors: the weights that mu pulls to. A client without samples keeps its state; samples of a client without a state are an error."""
    order = F.xxhash64(F.lit(seed), F.lit(number), F.col("id").cast("string"))
    rows = samples.filter("client IS NOT NULL AND x IS NOT NULL AND label IS NOT NULL").select(F.col("client").cast("long").alias("client"), F.lit(1).alias("kind"), order.alias("o"), F.col("id").cast("string").alias("id"), "x", F.col("label").cast("int").alias("label"), *[F.lit(None).cast(t).alias(c) for c, t in (("w", "array<double>"), ("m", "array<double>"), ("v", "array<double>"), ("step", "long"))])
    heads = states.select("client", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("o"), F.lit("").alias("id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("label"), "w", "m", "v", "step")
    dealt = heads.unionByName(rows).repartition("client").sortWithinPartitions("client", "kind", "o", "id", "label", "x")
    begun = None if anchors is None else np.asarray(anchors, float).reshape(p.dim + 1, p.classes)
    shape, beta1, beta2 = (p.dim + 1, p.classes), p.beta1, p.beta2
    grad = gradient

    class Client:
        def __init__(self, key: int, w: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> None:
            self.key, self.w, self.m, self.v, self.step = key, w.reshape(shape), m.reshape(shape), v.reshape(shape), step
            self.x, self.y, self.loss, self.n = [], [], 0.0, 0

        def fit(self) -> None:
            if not self.x:
                return
            x, y = np.stack(self.x), np.array(self.y)
            loss, g = grad(x, y, self.w, p.classes)
            if p.mu and begun is not None:
                loss += 0.5 * p.mu * float(((self.w - begun) ** 2).sum())
                g = g + p.mu * (self.w - begun)
            self.step += 1
            w = self.w * (1 - p.lr * p.weight_decay)
            self.m = beta1 * self.m + (1 - beta1) * g
            self.v = beta2 * self.v + (1 - beta2) * g * g
            self.w = w - p.lr * (self.m / (1 - beta1**self.step)) / (np.sqrt(self.v / (1 - beta2**self.step)) + p.eps)
            self.loss += loss * len(y)
            self.n += len(y)
            self.x, self.y = [], []

        def row(self) -> pa.RecordBatch:
            self.fit()
            lists = {c: pa.array([getattr(self, c).ravel().tolist()], pa.list_(pa.float64())) for c in "wmv"}
            return pa.RecordBatch.from_pydict({"client": pa.array([self.key], pa.int64()), **lists, "step": pa.array([self.step], pa.int64()), "loss": pa.array([self.loss / max(1, self.n)]), "n": pa.array([self.n], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Client | None = None
        for batch in batches:
            keys, kinds, labels = (batch[c].to_pylist() for c in ("client", "kind", "label"))
            for i, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
                if kind == 0:
                    if now:
                        yield now.row()
                    now = Client(key, *(np.array(batch[c][i].as_py(), float) for c in "wmv"), batch["step"][i].as_py())
                    continue
                if now is None or now.key != key:
                    raise ValueError(f"client {key} has samples and no state")
                now.x.append(batch["x"][i].values.to_numpy(zero_copy_only=False))
                now.y.append(labels[i])
                if len(now.y) == p.batch:
                    now.fit()
        if now:
            yield now.row()

    return dealt.mapInArrow(run, STATE)


def score(samples: DataFrame, w: np.ndarray, p: AdamW) -> DataFrame:
    """(label, correct, total, loss) of weights over samples (x, label), by class: partial sums of each task."""
    w = np.asarray(w, float).reshape(p.dim + 1, p.classes)

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                z = np.hstack([np.stack(pdf["x"].to_numpy()), np.ones((len(pdf), 1))]) @ w
                y, top = pdf["label"].to_numpy(), z.max(1)
                loss = np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]
                yield pd.DataFrame({"label": y, "correct": (z.argmax(1) == y).astype(np.int64), "loss": loss}).groupby("label", as_index=False).agg(correct=("correct", "sum"), total=("correct", "size"), loss=("loss", "sum"))

    rows = samples.filter("x IS NOT NULL AND label IS NOT NULL").select(F.col("label").cast("int").alias("label"), "x").mapInPandas(each, "label int, correct long, total long, loss double")
    return rows.groupBy("label").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.sum("loss").alias("loss"))


def train(samples: DataFrame, validation: DataFrame, p: AdamW, epochs: int, seed: int = 0) -> tuple[list[dict], dict, dict]:
    """One model over samples (id, x, label): (history, best, last). best is the state of the first epoch with the greatest validation accuracy, last the last one's; each has epoch, w, val_acc."""
    spark = samples.sparkSession
    own = samples.withColumn("client", F.lit(0).cast("long"))
    states = start(spark, [0], p)
    history, best, last = [], None, None
    for e in range(1, epochs + 1):
        states = cut(epoch(own, states, p, seed, e))
        s = states.first()
        r = score(validation, np.array(s["w"]), p).agg(F.sum("correct").alias("c"), F.sum("total").alias("t"), F.sum("loss").alias("l")).first()
        total = r["t"] or 0
        history.append({"epoch": e, "train_loss": s["loss"], "val_loss": (r["l"] or 0.0) / max(1, total), "val_acc": (r["c"] or 0) / max(1, total)})
        last = {"epoch": e, "w": np.array(s["w"]), "val_acc": history[-1]["val_acc"]}
        if best is None or last["val_acc"] > best["val_acc"]:
            best = last
    return history, best, last


def run_rounds(samples: DataFrame, evaluating: DataFrame, p: AdamW, rounds: int, epochs: int = 1, seed: int = 0, aggregate=None) -> list[dict]:
    """Federated rounds: every client fits some epochs from the global weights, the fits are averaged by samples (or by aggregate, over rows (client, pos, w, n)), and the new weights are evaluated by the evaluating clients' samples (client, x, label): each client's loss and accuracy, weighted by its samples. A client that fails, or has no samples, ends the loop with an error, not with a smaller mean. History of a round: clients, train_loss, loss, accuracy, classes (label: correct, total); the last has the weights."""
    spark = samples.sparkSession
    clients = [r[0] for r in samples.select(F.col("client").cast("long")).filter("client IS NOT NULL").distinct().orderBy("client").collect()]
    w = np.zeros(p.size)
    history: list[dict] = []
    for r in range(1, rounds + 1):
        states = start(spark, clients, p, w)
        for e in range(epochs):
            states = cut(epoch(samples, states, p, seed, r * 1_000 + e, w))
        facts = states.select("client", "n", "loss").collect()
        if idle := [f["client"] for f in facts if not f["n"]]:
            raise ValueError(f"clients {idle} have no samples in round {r}")
        sent = states.select("client", "n", F.posexplode("w").alias("pos", "w"))
        mean = aggregate(sent, len(clients)) if aggregate else sent.groupBy("pos").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
        w = np.zeros(p.size)
        for row in mean.collect():
            w[row["pos"]] = row["w"]
        if not np.isfinite(w).all():
            raise ValueError(f"the aggregate of round {r} isn't finite")
        by = {x["label"]: x for x in score(evaluating, w, p).collect()}
        total = sum(x["total"] for x in by.values())
        n = sum(f["n"] for f in facts)
        history.append({"round": r, "clients": len(facts), "train_loss": sum(f["loss"] * f["n"] for f in facts) / n, "loss": sum(x["loss"] for x in by.values()) / max(1, total), "accuracy": sum(x["correct"] for x in by.values()) / max(1, total), "classes": {k: (x["correct"], x["total"]) for k, x in sorted(by.items())}})
    history[-1]["weights"] = w
    return history
