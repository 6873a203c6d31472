"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs of other scripts and digits or
signs used as letters become Latin letters. The lexicon is learned from a
bounded sample of labelled rows: beginnings of words (of 4 to 8 characters, and
whole words of fewer, marked by a full stop) whose share among toxic documents
is far above that among others, with the log of that ratio as weight. A stem
that clean documents have by chance too is known by its inflections: documents
with two different words of that beginning are counted as well, and either count
may prove an entry. A beginning must follow several different words among the
toxic documents, so that a text with many copies doesn't make all its words look
toxic. Of entries that begin alike the better proven one stays.

Exception phrases are words that begin with an entry, alone or with the word
after them, and are found among clean documents rather than toxic ones; a match
of one doesn't count. The score is a logistic function of the weights' sum and
of that sum divided by the text's words.

Nulls: a null text is an empty one and scores as a text without matches; a null
label or id is no label. Of several labels of an id the least counts. Repeated
rows and ties score alike. Nothing but the text is an input of a score. Very
long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import held_out, plus, ready, released
from larkspur.llm.words import strings

#: Look-alike letters, and digits and signs written for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁԛԝһοαενικρτυ0134578@$", "aeopcyxijsdqwhoaevikptuoieastbas")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityFit:
    train_rows: int = 12_000
    lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    least_documents: int = 3
    least_weight: float = 1.5
    least_contexts: int = 5
    proof: float = 8.0
    stem_proof: float = 6.5
    threshold: float = 0.7


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = -4.0
    per_sum: float = 1.0
    per_rate: float = 0.0
    prior: float = 0.1

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, v in self.weights.items():
            word = k.removesuffix(".")
            a.add_word(word, (len(word), v, word != k))
        a.make_automaton()
        return a


def fold(text: str) -> str:
    return text.lower().translate(HOMOGLYPHS)


def matched(folded: str, automaton: ahocorasick.Automaton, exceptions: set[str]) -> tuple[float, int]:
    """The weights of the words that begin with an entry or are a whole one (the longest entry of a word counts), and how many they are."""
    if not len(automaton):
        return 0.0, 0
    best: dict[int, tuple[int, float]] = {}
    for end, (n, weight, whole) in automaton.iter(folded):
        start = end - n + 1
        if whole and folded[end + 1 : end + 2].isalnum():
            continue
        if (start == 0 or not folded[start - 1].isalnum()) and best.get(start, (0, 0.0))[0] < n:
            best[start] = (n, weight)
    total, count = 0.0, 0
    for start, (_, weight) in best.items():
        if exceptions and exceptions.intersection(phrases(folded, start)):
            continue
        total += weight
        count += 1
    return total, count


def phrases(folded: str, start: int) -> list[str]:
    """The word that begins at a place, and it with the word after it."""
    word = _WORD.match(folded, start)
    after = _WORD.search(folded, word.end())
    return [word[0], f"{word[0]} {after[0]}"] if after else [word[0]]


def _values(total: float, count: int, words: int) -> tuple[float, float]:
    return math.log1p(max(total, 0.0)), math.log1p(100 * max(total, 0.0) / (words + 20))


def _counts(batches: Iterator[pa.RecordBatch], p: ToxicityFit) -> Iterator[pa.RecordBatch]:
    """For each beginning and whole word (marked by a full stop), the toxic and other documents with it, and with two different words of it, of one task; contexts: a bit for each hash value of the word before it in a toxic document."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(strings(batch["text"]), batch["label"].to_pylist(), strict=True):
            seen: dict[str, list[int]] = {}
            before = ""
            for w in _WORD.findall(fold(text)):
                seen.setdefault(w + ".", [0, 1])[0] |= 1 << (zlib.crc32(before.encode()) % 63) if label else 0
                before = w
            for key, (bits, _) in list(seen.items()):
                for n in p.lengths:
                    if len(key) > n:
                        x = seen.setdefault(key[:n], [0, 0])
                        x[0] |= bits
                        x[1] += 1
            for key, (bits, words) in seen.items():
                c = counts.setdefault(key, [0, 0, 0, 0, 0])
                c[0 if label else 1] += 1
                if words > 1:
                    c[2 if label else 3] += 1
                c[4] |= bits
    keys = list(counts)
    for a in range(0, len(keys), 20_000):
        k = keys[a : a + 20_000]
        yield pa.RecordBatch.from_pydict({"gram": pa.array(k), **{name: pa.array([counts[x][i] for x in k], pa.int64()) for i, name in enumerate(("tox", "other", "tox2", "other2", "contexts"))}})


def _found_phrases(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """The words that begin with an entry, alone and with the next word: how many toxic and other documents have them, of one task."""
    a = lexicon.automaton()
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(strings(batch["text"]), batch["label"].to_pylist(), strict=True):
            folded = fold(text)
            starts = {end - n + 1 for end, (n, _, _) in a.iter(folded)}
            for x in {x for s in starts if s == 0 or not folded[s - 1].isalnum() for x in phrases(folded, s)}:
                counts.setdefault(x, [0, 0])[0 if label else 1] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_pydict({"phrase": pa.array(keys, pa.string()), "tox": pa.array([counts[x][0] for x in keys], pa.int64()), "other": pa.array([counts[x][1] for x in keys], pa.int64())})


def _match_rows(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    a = lexicon.automaton()
    for batch in batches:
        out = []
        for text in strings(batch["text"]):
            folded = fold(text)
            out.append((*matched(folded, a, lexicon.exceptions), folded.count(" ") + folded.count("\n") + 1))
        yield pa.RecordBatch.from_pydict({"label": batch["label"], "total": pa.array([x[0] for x in out]), "count": pa.array([x[1] for x in out], pa.int64()), "words": pa.array([x[2] for x in out], pa.int64())})


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Text and label of a bounded sample of the ids that may be learned from: about so many, chosen by a hash, and one text each (of several rows of an id the text of least hash), so repeated rows don't pile up."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, most / max(n, 1)))))
    return docs.select("doc_id", "text").join(rows, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x")).select("x.text", "x.label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (z * (1 - z))[:, None]) + ridge * np.eye(len(w)), x.T @ (z - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityFit = ToxicityFit()) -> Lexicon:
    """Without labels of both kinds the lexicon is empty and every score the prior's."""
    ready(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", p.train_rows).persist()
    by = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = by.get(1, 0), sum(n for k, n in by.items() if k != 1)
    lexicon = Lexicon(prior=(toxic + 1) / (toxic + other + 20))
    lexicon.bias = math.log(lexicon.prior / (1 - lexicon.prior))
    lexicon.per_sum = 0.0
    if not toxic or not other:
        rows.unpersist()
        return lexicon
    ratio = lambda x, y: F.log((F.col(x) + 0.5) / (toxic + 1)) - F.log((F.col(y) + 0.5) / (other + 1))
    marked = rows.select("text", (F.col("label") == 1).alias("label"))
    counts = marked.mapInArrow(lambda it: released(_counts(it, p)), "gram string, tox long, other long, tox2 long, other2 long, contexts long")
    counts = counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("tox", "other", "tox2", "other2")), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    counts = counts.withColumn("weight", ratio("tox", "other")).withColumn("weight2", ratio("tox2", "other2"))
    # evidence: how surely a ratio isn't chance (the signed root of the likelihood ratio's main term)
    single = (F.col("tox") >= p.least_documents) & (F.col("weight") * F.sqrt("tox") >= p.proof)
    stem = (F.col("tox2") >= p.least_documents) & (F.col("weight2") * F.sqrt("tox2") >= p.stem_proof)
    found = counts.filter((single | stem) & (F.col("weight") >= p.least_weight) & (F.col("contexts") >= p.least_contexts) & (~F.col("gram").endswith(".") | (F.length("gram") <= min(p.lengths))))
    found = found.withColumn("proof", F.greatest(F.col("weight") * F.sqrt("tox"), F.col("weight2") * F.sqrt("tox2"))).orderBy(F.desc("proof"), F.length("gram"), "gram").collect()
    chosen: dict[str, float] = {}
    for r in found:
        g = r["gram"]
        if not any(g.startswith(k) or k.startswith(g) for k in chosen):
            # the longest beginning with the same documents says the same and matches less
            best = max((x for x in found if x["gram"].startswith(g) and x["tox"] >= 0.95 * r["tox"]), key=lambda x: len(x["gram"]))
            chosen[best["gram"]] = float(min(best["weight"], 6.0))
    lexicon.weights = dict(sorted(chosen.items()))
    if lexicon.weights:
        said = marked.mapInArrow(lambda it: released(_found_phrases(it, lexicon)), "phrase string, tox long, other long").groupBy("phrase").agg(F.sum("tox").alias("tox"), F.sum("other").alias("other"))
        lexicon.exceptions = {r["phrase"] for r in said.filter((F.col("other") >= p.least_documents) & (ratio("tox", "other") < 0)).select("phrase").collect()}
    got = rows.mapInArrow(lambda it: released(_match_rows(it, lexicon)), "label int, total double, count long, words long").collect()
    rows.unpersist()
    x = np.array([_values(r["total"], r["count"], r["words"]) for r in got])
    y = np.array([float(r["label"] == 1) for r in got])
    lexicon.per_sum, lexicon.per_rate, lexicon.bias = (float(v) for v in logistic(x, y))
    return lexicon


def _scores(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    a = lexicon.automaton()
    for batch in batches:
        out, hits = [], []
        for text in strings(batch["text"]):
            folded = fold(text)
            total, count = matched(folded, a, lexicon.exceptions)
            s, r = _values(total, count, folded.count(" ") + folded.count("\n") + 1)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.bias + lexicon.per_sum * s + lexicon.per_rate * r)))))
            hits.append(count)
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names} | {"_score": pa.array(out, pa.float64()), "_hits": pa.array(hits, pa.int64())})


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with _score (0 to 1) and _hits (matched words). Columns of docs with these names are replaced."""
    ready(docs.sparkSession)
    docs = docs.drop("_score", "_hits")
    return docs.mapInArrow(lambda it: released(_scores(it, lexicon)), plus(docs, "_score double, _hits bigint"))
