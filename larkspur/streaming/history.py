"""Round history of runs as a stream with state: each round counts once, however often its event comes.

State is kept for a run: the rounds seen in each phase, as a map from the round
to its event's digest. A replayed event changes nothing; nor does a late one
that says otherwise, which is reported as a conflict. Any number of rounds; a
run's state has an entry a round and stays, so that a replay is known whenever
it comes. The sink writes a batch's rows into a folder of the batch's number,
so a batch that runs again after a failure replaces its own rows and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "experiment_id string, round int, phase string, num_clients int, num_failures int, loss double, accuracy double, ts_utc string"
OUT = "experiment_id string, round int, phase string, num_clients int, num_failures int, loss double, accuracy double, status string, good_rounds int, complete boolean"
STATE = "rounds array<int>, phases array<string>, digests array<long>, good array<int>"


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def evaluated(before: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The events of a round's evaluation: before (keys, round, num_clients, num_failures) with results (keys, round, loss, accuracy); what isn't finite is null, and so is a round without results."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    j = before.join(results.select(*keys, "round", finite("loss"), finite("accuracy")), [*keys, "round"], "left")
    return j.select(*keys, "round", F.lit("evaluate").alias("phase"), "num_clients", "num_failures", "loss", "accuracy")


def history(stream: DataFrame, rounds: int) -> DataFrame:
    """The rows of OUT for each event that a run's history hasn't: status is new, or conflict for an event that contradicts one before. good_rounds counts the evaluated rounds up to then that had clients and no failures; complete is whether they are all of 1 to rounds. A replayed event gives no row. Events without a run, round or phase are left out."""
    values = ["num_clients", "num_failures", "loss", "accuracy"]
    clean = stream.filter("experiment_id IS NOT NULL AND round IS NOT NULL AND phase IS NOT NULL")
    clean = clean.select("experiment_id", "round", "phase", *values, F.xxhash64(*values).alias("digest"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen_rounds, seen_phases, digests, good = state.get if state.exists else ([], [], [], [])
        seen = {(r, p): d for r, p, d in zip(seen_rounds, seen_phases, digests, strict=True)}
        done = set(good)
        out = []
        for e in sorted((e for b in batches for e in b.itertuples(index=False)), key=lambda e: (e.round, e.phase, e.digest)):
            at = (int(e.round), e.phase)
            if seen.get(at) == int(e.digest):
                continue
            status = "conflict" if at in seen else "new"
            if status == "new":
                seen[at] = int(e.digest)
                if e.phase == "evaluate" and 1 <= e.round <= rounds and e.num_clients > 0 and e.num_failures == 0:
                    done.add(int(e.round))
            number = lambda v: None if v is None or v != v else float(v)
            out.append((key[0], at[0], at[1], e.num_clients, e.num_failures, number(e.loss), number(e.accuracy), status, len(done), len(done) == rounds))
        at = sorted(seen)
        state.update(([r for r, _ in at], [p for _, p in at], [seen[x] for x in at], sorted(done)))
        if out:
            frame = pd.DataFrame(out, columns=["experiment_id", "round", "phase", *values, "status", "good_rounds", "complete"])
            for c in ("num_clients", "num_failures"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return clean.groupBy("experiment_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def sink(rows: DataFrame, path: str, checkpoint: str):
    """Starts writing: each batch replaces the folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history that a sink wrote; conflicts have rows of their own."""
    return spark.read.schema(f"{OUT}, batch int").parquet(path)


def standing(rows: DataFrame) -> DataFrame:
    """(experiment_id, good_rounds, complete) by the history so far."""
    return rows.groupBy("experiment_id").agg(F.max("good_rounds").alias("good_rounds"), F.max("complete").alias("complete"))
