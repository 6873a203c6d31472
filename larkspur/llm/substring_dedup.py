"""Substring dedup: sentences covered by a repeated span of sentences go, but for the span's first place.

A sentence ends at . ! ? … or a line end. Beyond its first long words a sentence
is also cut after every word whose hash divides by cut: places that depend on
the words nearby only, so a passage inside other sentences is cut alike in all.
For every sentence the shortest run from it
forwards and the shortest run back from it, of at least run sentences and
least_words words, are hashed over their words. An aggregation that combines
before the shuffle gives each hash's first place, the least (doc_id, position);
the spans join it and every other place is removed. Overlapping spans add up.

With passage, every run of so many words that repeats goes too, wherever it
starts (sentences then need no cuts of their own). Of the runs of anchor words
in it the one of least hash stands for it: equal runs have equal anchors, so
the anchors are spans like the others. A repeated anchor is then extended word
by word, to both sides, as far as the words are those around its first place:
only the outer anchors of a chain that has its first places in one document, at
one distance, ask for the words there, and each asked place answers once. A
repeated run whose first place isn't its anchor's first place keeps the words
that the two places don't share, fewer than passage - anchor on a side.

Texts travel compressed, and each step's shuffles are let go before the next
step, so the disk holds the largest step's and not their sum. Nulls: a null text stays null. Rows with a null doc_id
stay as they are and are no place of a span. Rows that share a doc_id share
their positions: a row is changed only where its own words have the span's
hash. Ids of any type that sorts will do. Empty tables and texts, ties and very
long texts need no special case. Other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import cut, freed, fresh, plus, ready, released
from larkspur.llm.words import MUL, MUL_INV, Words, mix, steps, strings


@dataclass(frozen=True)
class SentenceSpans:
    run: int = 3
    least_words: int = 16
    long: int = 12
    cut: int = 8
    passage: int = 0
    anchor: int = 25


#: Sentences, and every repeated run of 50 words.
WHOLE = replace(SentenceSpans(), passage=50)

#: A place of a span as it is kept for its document: words from s to e, the hash, the first place's word and its document's place in a list.
_PLACE = np.dtype([("s", "<i4"), ("e", "<i4"), ("h", "<i8"), ("fs", "<i4"), ("who", "<i4")])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(w: Words, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = len(w.hash)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers(MUL, n), dtype=np.uint64)])
    return mix((total[e] - total[s]) * powers(MUL_INV, n + 1)[s] ^ (e - s).astype(np.uint64))


def anchors(w: Words, p: SentenceSpans) -> np.ndarray:
    """Where the anchors of all runs of passage words begin: of each run's runs of anchor words the one of least hash, of equal ones the last."""
    n = len(w.hash)
    if n < p.passage:
        return np.zeros(0, np.int64)
    at = np.arange(n - p.anchor + 1)
    value = run_hashes(w, at, at + p.anchor)
    # least of 1, 2, 4 ... candidates from each place, then of all
    wanted, width, place = p.passage - p.anchor + 1, 1, at
    while width < wanted:
        step = min(width, wanted - width)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(value[right] <= value[left], right, left)
        width += step
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    begin = np.arange(n - p.passage + 1)
    return np.unique(place[text[begin] == text[begin + p.passage - 1]])


def spans(w: Words, p: SentenceSpans) -> dict[str, np.ndarray]:
    """text: which text; start, end: the words of a span of sentences, within its text; hash."""
    n = len(w.hash)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    ends = w.ends
    if not p.passage:
        starts = np.append(0, np.flatnonzero(w.ends)[:-1] + 1) if n else np.zeros(0, np.int64)
        sentence = np.cumsum(np.append(0, w.ends[:-1])) if n else np.zeros(0, np.int64)
        within = np.arange(n) - starts[sentence] if n else starts
        ends = w.ends | ((within >= p.long) & ((w.hash >> np.uint64(32)) % np.uint64(p.cut) == 0))
    end = np.flatnonzero(ends) + 1
    begin = np.append(0, end[:-1])[: len(end)]
    owner = text[begin] if n else text
    # units by index: a run of units [i, j] with j - i + 1 >= run and words >= least_words
    i = np.arange(len(end))
    forward = np.maximum(i + p.run - 1, np.searchsorted(end, begin + p.least_words))
    back = np.minimum(i - p.run + 1, np.searchsorted(begin, end - p.least_words, side="right") - 1)
    ok = (forward < len(end)) & (owner[np.minimum(forward, len(end) - 1)] == owner) if n else i < 0
    fi, fj = i[ok], forward[ok]
    ok = (back >= 0) & (owner[np.maximum(back, 0)] == owner) if n else i < 0
    bi, bj = back[ok], i[ok]
    new = np.ones(len(bi), bool)
    if len(fi):
        at = np.minimum(np.searchsorted(fi, bi), len(fi) - 1)
        new = ~((fi[at] == bi) & (fj[at] == bj))
    a, b = np.concatenate([fi, bi[new]]), np.concatenate([fj, bj[new]])
    s, e = begin[a], end[b]
    value = run_hashes(w, s, e) & ~np.uint64(1)
    base = w.first[owner[a]] if n else s
    return {"text": owner[a] if n else a, "start": s - base, "end": e - base, "hash": value}


def marks(w: Words, p: SentenceSpans) -> dict[str, np.ndarray]:
    """The spans of sentences and, with passage, the anchors: their hashes are odd."""
    out = spans(w, p)
    if not p.passage:
        return out
    at = anchors(w, p)
    text = np.searchsorted(w.first, at, side="right") - 1
    s = at - w.first[text]
    more = {"text": text, "start": s, "end": s + p.anchor, "hash": run_hashes(w, at, at + p.anchor) | np.uint64(1)}
    return {k: np.concatenate([out[k], more[k]]) for k in out}


def _marks(batches: Iterator[pa.RecordBatch], p: SentenceSpans) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch["text"])
        for a, b in steps(texts):
            x = marks(Words(texts[a:b], sentences=True), p)
            for k in range(0, len(x["hash"]), 100_000):
                at = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x["hash"][at].view(np.int64)), batch["doc_id"].take(pa.array(a + x["text"][at])), pa.array(x["start"][at].astype(np.int32)), pa.array(x["end"][at].astype(np.int32))], ["h", "doc_id", "s", "e"])


def repeated_spans(docs: DataFrame, p: SentenceSpans = SentenceSpans()) -> DataFrame:
    """Spans at other places than their first: h, doc_id, s, e (words), first and fs (the first place's doc_id and word)."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(lambda it: released(_marks(it, p)), f"h long, doc_id {kind}, s int, e int")
    first = made.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("h", F.col("f.doc_id").alias("first"), F.col("f.s").alias("fs"))
    # cut: so the join reads both sides from exchanges, and adaptive execution can split a hot hash
    first = cut(first)
    freed(docs.sparkSession)
    return made.join(first, "h").filter("doc_id <> first OR s <> fs")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        small = [None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({c: pa.array(small, pa.binary()) if c == "text" else batch[c] for c in batch.schema.names})


def packed(docs: DataFrame) -> DataFrame:
    """docs with their texts compressed."""
    return docs.mapInArrow(_packed, T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema]))


def unpacked(column: pa.Array) -> list[str | None]:
    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x).decode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's places as compressed numbers, with the list of the documents that hold their first places."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        found = batch["found"]
        at, column = found.offsets.to_numpy().astype(np.int64), found.values
        who = column.field(3)
        places, lists = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            coded = who.slice(a, b - a).dictionary_encode()
            x = np.zeros(b - a, _PLACE)
            for k, name in ((0, "s"), (1, "e"), (2, "h"), (4, "fs")):
                x[name] = column.field(k).slice(a, b - a).to_numpy(zero_copy_only=False)
            x["who"] = coded.indices.to_numpy(zero_copy_only=False)
            places.append(z.compress(np.sort(x, order=["s", "e", "h"]).tobytes()))
            lists.append(coded.dictionary)
        sizes = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(places, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(lists) if lists else who.slice(0, 0))], ["doc_id", "found", "firsts"])


def placed(found: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(found), _PLACE)


def outer(x: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's places, sorted: the anchors that begin a chain and those that end one. A chain's anchors follow each other without a gap here and at their first places."""
    at = np.flatnonzero(x["h"] & 1)
    if not len(at):
        return at, at
    y = x[at]
    new = np.append(True, (y["who"][1:] != y["who"][:-1]) | (y["s"][1:] - y["s"][:-1] != y["fs"][1:] - y["fs"][:-1]) | (y["s"][1:] - y["s"][:-1] > anchor))
    return at[new], at[np.append(new[1:], True)]


def _asks(batches: Iterator[pa.RecordBatch], p: SentenceSpans) -> Iterator[pa.RecordBatch]:
    """For each outer anchor the place whose words it asks for: those before it (left) or after it."""
    for batch in batches:
        who = batch["firsts"]
        base = who.offsets.to_numpy()
        parts, owner, first, left = [], [], [], []
        for k, found in enumerate(batch["found"].to_pylist()):
            x = placed(found)
            for side, at in zip((True, False), outer(x, p.anchor), strict=True):
                parts.append(x[at])
                owner.append(np.full(len(at), k))
                first.append(base[k] + x["who"][at].astype(np.int64))
                left.append(np.full(len(at), side))
        x, k = np.concatenate(parts), np.concatenate(owner)
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(k)), pa.array(x["s"]), pa.array(np.concatenate(left)), who.values.take(pa.array(np.concatenate(first))), pa.array(x["fs"]), pa.array(x["h"])], ["doc_id", "s", "left", "first", "fs", "h"])


def _answers(batches: Iterator[pa.RecordBatch], p: SentenceSpans) -> Iterator[pa.RecordBatch]:
    """The words beside asked places, nearest first, of a row that has the anchor there."""
    far = p.passage - p.anchor
    for batch in batches:
        asks = batch["asks"]
        offsets = asks.offsets.to_numpy()
        fs, h, left = (asks.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out: list[tuple[int, int, bool, bytes]] = []
        for a, b in steps(texts := [x or "" for x in unpacked(batch["text"])]):
            w = Words(texts[a:b])
            for t in range(a, b):
                lo, hi = int(w.first[t - a]), int(w.first[t - a + 1])
                at = np.arange(offsets[t], offsets[t + 1])
                s = lo + fs[at].astype(np.int64)
                ok = s + p.anchor <= hi
                at, s = at[ok], s[ok]
                ok = (run_hashes_of(w, s, p.anchor) | np.uint64(1)).view(np.int64) == h[at]
                for k, x in zip(at[ok].tolist(), s[ok].tolist(), strict=True):
                    words = w.hash[max(lo, x - far) : x][::-1] if left[k] else w.hash[x + p.anchor : min(hi, x + p.anchor + far)]
                    out.append((t, int(fs[k]), bool(left[k]), (words >> np.uint64(32)).astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.bool_()), pa.array([x[3] for x in out], pa.binary())], ["first", "fs", "left", "words"])


def run_hashes_of(w: Words, s: np.ndarray, size: int) -> np.ndarray:
    """As run_hashes, of a few runs of one size."""
    value = np.zeros(len(s), np.uint64)
    power = powers(MUL, size)
    for k in range(0, len(s), 10_000):
        part = s[k : k + 10_000]
        value[k : k + 10_000] = (w.hash[part[:, None] + np.arange(size)] * power).sum(1, dtype=np.uint64)
    return mix(value ^ np.uint64(size))


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without(text: str, tokens: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without ranges of words, and the removed ranges of characters; tokens: each word's place among the text's tokens."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    out, gone, last = [], [], 0
    for s, e in ranges:
        to = int(tokens[e]) if e < len(tokens) else len(at)
        begin, end = at[int(tokens[s])][0], at[to][0] if to < len(at) else len(text)
        out.append(text[last:begin])
        gone.append((begin, end))
        last = end
    return "".join(out) + text[last:], gone


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the beginning are the same."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(same.argmin())


def ranges_of(own: np.ndarray, x: np.ndarray, told: list[dict], p: SentenceSpans) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The ranges of words to remove from a text with these words, and which of its places it really holds."""
    size = x["e"] - x["s"]
    ok = x["e"] <= len(own)
    at = np.flatnonzero(ok)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(MUL, len(own)), dtype=np.uint64)])
    s, e = x["s"][at], x["e"][at]
    value = mix((total[e] - total[s]) * powers(MUL_INV, len(own) + 1)[s] ^ size[at].astype(np.uint64))
    ok[at] = (value | np.uint64(1)) == (x["h"][at].view(np.uint64) | np.uint64(1))
    found = list(zip(x["s"][ok].tolist(), x["e"][ok].tolist(), strict=True))
    if told:
        short = (own >> np.uint64(32)).astype(np.uint32)
        real = set(x["s"][ok & ((x["h"] & 1) == 1)].tolist())
        for r in told:
            if (s := r["s"]) in real:
                words = np.frombuffer(r["words"], np.uint32)
                found.append((s - alike(short[:s][::-1], words), s) if r["left"] else (s + p.anchor, s + p.anchor + alike(short[s + p.anchor :], words)))
    return _merged(found), ok


def _remove(batches: Iterator[pa.RecordBatch], p: SentenceSpans, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        out, ranges, firsts = unpacked(batch["text"]), [[]] * n, [[]] * n
        found, who, told = (batch[c] for c in names)
        rows = [k for k in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist() if out[k]]
        for a, b in steps([out[k] for k in rows]):
            part = rows[a:b]
            w = Words([out[k] for k in part], sentences=True)
            for t, k in enumerate(part):
                at = slice(int(w.first[t]), int(w.first[t + 1]))
                x = placed(found[k].as_py())
                kept, ok = ranges_of(w.hash[at], x, told[k].as_py() or [], p)
                if kept:
                    out[k], gone = without(out[k], w.token[at], kept)
                    ranges[k] = [{"start": s, "end": e} for s, e in gone]
                    firsts[k] = sorted({who[k].as_py()[i] for i in np.unique(x["who"][ok]).tolist()})
        kind = pa.list_(who.type.value_type)
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c not in names} | {"text": pa.array(out, pa.string()), "_ranges": pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "_firsts": pa.array(firsts, kind)})


def dedup(docs: DataFrame, p: SentenceSpans = SentenceSpans()) -> DataFrame:
    """docs with the repeated sentences taken out of text; _ranges: the removed ranges of characters, _firsts: ids of the documents that hold the removed spans' first places. Columns of docs with these two names are replaced."""
    docs = docs.drop("_ranges", "_firsts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, p)
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        spans = spans.distinct()  # identical rows of an id have the same places
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "h", "first", "fs")).alias("found"))
    found = cut(found.mapInArrow(_gathered, f"doc_id {kind}, found binary, firsts array<{kind}>"))
    del spans
    freed(docs.sparkSession)
    told = found.select("doc_id", F.lit(None).cast("array<struct<s:int,left:boolean,words:binary>>").alias("told")).limit(0)
    if p.passage:
        asks = found.mapInArrow(lambda it: released(_asks(it, p)), f"doc_id {kind}, s int, left boolean, first {kind}, fs int, h long")
        wanted = asks.groupBy("first").agg(F.collect_set(F.struct("fs", "h", "left")).alias("asks"))
        held = packed(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")).join(wanted, F.col("doc_id") == F.col("first")).select("doc_id", "text", "asks")
        # cut: so the join reads both sides from exchanges, and adaptive execution can split a hot place
        answers = cut(held.mapInArrow(lambda it: released(_answers(it, p)), f"first {kind}, fs int, left boolean, words binary").distinct())
        freed(docs.sparkSession)
        told = asks.join(answers, ["first", "fs", "left"]).groupBy("doc_id").agg(F.collect_list(F.struct("s", "left", "words")).alias("told"))
    names = tuple(fresh(docs, x) for x in ("found", "firsts", "told"))
    changes = found.join(told, "doc_id", "left").select(F.col("doc_id").alias(own := fresh(docs, "id")), *(F.col(c).alias(x) for c, x in zip(("found", "firsts", "told"), names, strict=True)))
    joined = packed(docs).join(changes, F.col("doc_id") == F.col(own), "left").drop(own)
    return joined.mapInArrow(lambda it: released(_remove(it, p, names)), plus(docs, f"_ranges array<struct<start:int,end:int>>, _firsts array<{kind}>"))
