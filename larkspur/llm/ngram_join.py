"""N-gram Jaccard join: documents whose sets of word shingles are alike.

Texts with equal shingle sets collapse first, by a 128-bit fingerprint, with
an aggregation that combines before the shuffle; only one of them goes on.
Bands of MinHash values gather candidates; within a band's bucket the values of
each pair are compared a few at a time, and a pair goes as soon as its posterior
probability of reaching the threshold (uniform prior) is below the tolerance.
The components of what is left bound the exact comparison: inside them every
pair's Jaccard is computed from the whole shingle sets. Buckets and components
of any size are dealt as pairs of blocks, so no task holds more than two blocks
and no row is made for a pair: a task returns a sum and a star per member.

With 20 bands of 3 values a pair of Jaccard 0.8 misses all bands with a
probability of 6e-7; a pair missed by them is still compared when other pairs
put both texts in one component.

Nulls: a null text is an empty one. Texts without a word are equal to one
another. A null doc_id takes part; the class id is the least id that isn't null
(null when all are). Repeated rows are copies of each other. Columns other than
doc_id and text aren't touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import components, cut, fresh, ready, released
from larkspur.llm.words import MinHash, Words, mix, shingles, steps, strings, whole_groups


@dataclass(frozen=True)
class JaccardJoin:
    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    band_rows: int = 3
    tolerance: float = 1e-5
    at_once: int = 10
    bucket_block: int = 512
    verify_block: int = 128

    @property
    def values(self) -> int:
        return self.bands * self.band_rows


def fingerprint(s: np.ndarray) -> bytes:
    a, b = mix(s ^ np.uint64(0x51ED270B35AE8D1F)), mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    return int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int((b ^ np.uint64(len(s))).sum(dtype=np.uint64)).to_bytes(8, "big")


def least_matches(p: JaccardJoin) -> dict[int, int]:
    """For so many compared values, the fewest matches with which the posterior probability of reaching the threshold is not below the tolerance. Beta(1 + m, 1 + n - m) exceeds t as often as a binomial (n + 1, t) is at most m."""
    out = {}
    for n in range(p.at_once, p.values + 1, p.at_once):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * p.threshold**m * (1 - p.threshold) ** (n + 1 - m)
            if tail >= p.tolerance:
                break
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, p: JaccardJoin, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a[i], b[j]), those that the incremental comparison keeps."""
    got = np.zeros(len(i), np.int16)
    for n, least in need.items():
        if not len(i):
            break
        at = slice(n - p.at_once, n)
        for k in range(0, len(i), 200_000):
            got[k : k + 200_000] += (a[i[k : k + 200_000], at] == b[j[k : k + 200_000], at]).sum(1, dtype=np.int16)
        keep = got >= least
        i, j, got = i[keep], j[keep], got[keep]
    return i, j


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, i, old[j])
        np.minimum.at(label, j, old[i])
        label = label[label]
        if (label == old).all():
            return label


def _signatures(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    hasher = MinHash(p.values)
    for batch in batches:
        texts = strings(batch["text"])
        for a, b in steps(texts):
            sets = shingles(Words(texts[a:b]), p.words)
            sig = hasher.of(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(a, b - a), "tk": batch["tk"].slice(a, b - a), "fp": pa.array([fingerprint(s) for s in sets], pa.binary()), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _candidates(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    need = least_matches(p)
    for table, at in whole_groups(batches, ["bucket", "bi", "bj"]):
        sig, own = _matrix(table["sig"], p.values), table["own"].to_numpy()
        bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
        found_i, found_j = [], []
        sizes = np.diff(at)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 48)]):
            starts = at[:-1][sizes == size]
            starts = starts[bi[starts] == bj[starts]]
            x, y = np.triu_indices(int(size), 1)
            for k in range(0, len(starts), 4096):
                i, j = surviving(sig, sig, (starts[k : k + 4096, None] + x).ravel(), (starts[k : k + 4096, None] + y).ravel(), p, need)
                found_i.append(i)
                found_j.append(j)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            inner = bi[s] == bj[s]
            if e - s < 2 or inner and e - s <= 48:
                continue
            left = np.arange(s, e) if inner else s + np.flatnonzero(own[s:e] == bi[s])
            right = left if inner else s + np.flatnonzero(own[s:e] == bj[s])
            for k in range(0, len(left), 128):
                rows = left[k : k + 128]
                i, j = np.repeat(rows, len(right)), np.tile(right, len(rows))
                if inner:
                    i, j = i[i < j], j[i < j]
                i, j = surviving(sig, sig, i, j, p, need)
                found_i.append(i)
                found_j.append(j)
        if found_i and sum(map(len, found_i)):
            yield _star(table["fp"].to_pylist(), np.concatenate(found_i), np.concatenate(found_j))


def _star(fp: list[bytes], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    order = sorted({fp[k] for k in np.unique(np.concatenate([i, j]))})
    place = {x: n for n, x in enumerate(order)}
    to = np.array([place.get(x, -1) for x in fp])
    label = labels(len(order), to[i], to[j])
    moved = np.flatnonzero(label != np.arange(len(order)))
    return pa.RecordBatch.from_pydict({"a": pa.array([order[k] for k in moved], pa.binary()), "b": pa.array([order[k] for k in label[moved]], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch["text"])
        for a, b in steps(texts):
            sets = shingles(Words(texts[a:b]), p.words)
            out = {c: batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(out | {"sets": pa.array([s.tobytes() for s in sets], pa.binary())})


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share; columns go by chunks, so memory is bounded by the block."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group)
    column = np.cumsum(often > 1) - 1
    use = often[group] > 1
    column, owner = column[group][use], owner[use]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    for table, at in whole_groups(batches, ["root", "bi", "bj"], 2000):
        fps, weights = table["fp"].to_pylist(), table["weight"].to_numpy()
        raw, own = table["sets"], table["own"].to_numpy()
        bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
        out_fp, out_links, out_label = [], [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = list({fps[k]: k for k in range(s, e)}.values())
            sets = [np.frombuffer(raw[k].as_py(), np.uint64) for k in rows]
            inter = shared(sets)
            size = np.array([len(x) for x in sets], np.float64)
            link = inter >= p.threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            np.fill_diagonal(link, False)
            if bi[s] != bj[s]:
                side = own[rows] == bi[s]
                link &= side[:, None] != side[None, :]
            i, j = np.nonzero(link)
            label = labels(len(rows), i, j)
            order = [fps[k] for k in rows]
            least: dict[int, bytes] = {}
            for k, x in enumerate(label.tolist()):
                least[x] = min(least.get(x, order[k]), order[k])
            out_fp += order
            out_links += (link @ weights[rows]).astype(np.int64).tolist()
            out_label += [least[x] for x in label.tolist()]
        yield pa.RecordBatch.from_pydict({"fp": pa.array(out_fp, pa.binary()), "links": pa.array(out_links, pa.int64()), "label": pa.array(out_label, pa.binary())})


def _dealt(df: DataFrame, key: str, count: str, block: int, id_col: str = "fp") -> DataFrame:
    """A row for each pair of blocks that a member belongs to, dealt by that pair and sorted by it."""
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(id_col), n).cast("int")
    out = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", count)
    return out.repartition(F.col(key), F.col("bi"), F.col("bj")).sortWithinPartitions(key, "bi", "bj")


def signatures(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: released(_signatures(it, p)), f"doc_id {kind}, tk long, fp binary, sig binary")


def classes(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least doc_id of the class), n_links (other rows of Jaccard at or above the threshold, copies among them), n_copies (rows with the same shingle set), kept_key (whether the row's (doc_id, tk) is the class's least), tk (xxhash64 of the text)."""
    ready(docs.sparkSession)
    rows = cut(signatures(docs, p))
    reps = cut(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.first("sig").alias("sig")))
    width = 2 * p.band_rows
    buckets = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    bands = reps.select("fp", F.explode(buckets).alias("bucket"))
    # sums are cut before they are joined back: the join then reads exchanges on both sides, and a hot key can be split
    members = bands.join(cut(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")), "bucket").join(reps.select("fp", "sig"), "fp")
    edges = _dealt(members, "bucket", "n", p.bucket_block).mapInArrow(lambda it: released(_candidates(it, p)), "a binary, b binary")
    near = components(edges)
    sized = near.join(cut(near.groupBy("root").agg(F.count("*").alias("n"))), "root").join(reps.select(F.col("fp").alias("node"), "rep", "weight"), "node")
    sized = sized.select(F.col("node").alias("fp"), F.xxhash64("root").alias("root"), "n", "weight", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tk").alias("rep_tk"))
    text = docs.select(F.col("doc_id").alias("rep_id"), "text").withColumn("rep_tk", F.xxhash64("text"))
    found = sized.alias("s").join(text.alias("t"), F.expr("s.rep_tk = t.rep_tk AND s.rep_id <=> t.rep_id")).select("s.fp", "s.root", "s.n", "s.weight", "t.text")
    if not rows.groupBy("doc_id", "tk").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        found = found.dropDuplicates(["fp"])  # every one of the representative's identical rows has joined
    sets = found.mapInArrow(lambda it: released(_sets(it, p)), "fp binary, root long, n long, weight long, sets binary")
    checked = cut(_dealt(sets, "root", "n", p.verify_block).mapInArrow(lambda it: released(_verify(it, p)), "fp binary, links long, label binary"))
    roots = components(checked.select(F.col("fp").alias("a"), F.col("label").alias("b")))
    links = checked.groupBy("fp").agg(F.sum("links").alias("links"))
    own = reps.join(links, "fp", "left").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = cut(own.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min(F.struct("rep.doc_id", "rep.tk")).alias("keeper")))
    # a null id sorts first in a struct: it may be the keeper, but never the class id while another is there
    facts = own.join(whole, "root").select("fp", "class_id", "keeper", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n_copies"))
    kept = (F.col("keeper.tk") == F.col("tk")) & F.col("keeper.doc_id").eqNullSafe(F.col("doc_id"))
    return rows.select("doc_id", "tk", "fp").join(facts, "fp").select("doc_id", "class_id", "n_links", "n_copies", kept.alias("kept_key"), "tk")


def one_of_each(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """docs with one row of each class: the least doc_id. Identical rows count once."""
    own, key, count, mine = (fresh(docs, x) for x in ("id", "tk", "n", "own_tk"))
    kept = classes(docs, p).filter("kept_key").select(F.col("doc_id").alias(own), F.col("tk").alias(key))
    alone = cut(kept.groupBy(own, key).agg(F.count("*").alias(count)))
    joined = docs.withColumn(mine, F.xxhash64("text")).join(alone, (F.col(mine) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)))
    if alone.filter(F.col(count) > 1).limit(1).count():
        joined = joined.dropDuplicates([own, key])
    return joined.select(*docs.columns)
