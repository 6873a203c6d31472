"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised to their lower-cased words joined by single spaces. Every
window of an item, at each of its characters, is looked for. An occurrence of a
window of w characters with at most k edits shares at least w + 1 - q (k + 1)
character q-grams with it, all on diagonals at most k apart; so hits of an
item's q-grams are gathered in diagonal bands of width 2k + 1 or more, each
overlapping the next by half, and only windows with that many hits in a band go
on. A hit on every q-gram of a window along one diagonal is the window itself;
else a banded alignment (edit distance along the band's diagonals) of all the
windows of the band verifies them. For q = 12 and windows of 96 characters and
6 edits, enough for a replaced word, 13 shared q-grams are needed; shorter
items get a smaller budget, and items shorter than q match only as whole words
in a row.

Hits are gathered in overlapping segments of a bounded number of hits, so a text
that repeats itself takes no more memory than another.

The benchmark is a broadcast only in blocks of a bounded number of characters;
a larger benchmark makes more passes over the documents.

Nulls: a null text or item matches nothing; neither does an empty one. A null
doc_id or item_id is returned as it is. Repeated rows each give their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import fresh, ready, released
from larkspur.llm.words import mix, steps, strings

_GAP = re.compile(r"[\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakSearch:
    q: int = 12
    window: int = 96
    step: int = 1
    edit_rate: float = 1 / 16
    block_chars: int = 8_000_000
    most_hits: int = 2_000_000

    def budget(self, length: int) -> int:
        """The edits allowed in a window of this length: the rate's, as far as the lemma still asks for two shared q-grams."""
        return max(0, min(int(length * self.edit_rate), (length - 1) // self.q - 1))

    def needed(self, length: int) -> int:
        return max(1, length + 1 - self.q * (self.budget(length) + 1))


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value of the q codes from each place, by doubling."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    power, width, factor = c.astype(np.uint64) + np.uint64(1), 1, _M
    out, have = None, 0
    rest = q
    while True:
        if rest & 1:
            part = power[have : have + len(c) - q + 1]
            out = part.copy() if out is None else out * factor_of(width) + part
            have += width
        rest >>= 1
        if not rest:
            return mix(out)
        power = power[:-width] * factor_of(width) + power[width:]
        width *= 2


def factor_of(width: int) -> np.uint64:
    return np.uint64(pow(int(_M), width, 2**64))


class Items:
    """The q-grams of a block of benchmark items."""

    def __init__(self, rows: list[tuple[object, str]], p: LeakSearch) -> None:
        self.p = p
        self.ids = [r[0] for r in rows]
        self.texts = [normal(r[1] or "") for r in rows]
        self.short = ahocorasick.Automaton()
        values, places, owners = [], [], []
        for n, t in enumerate(self.texts):
            if 0 < len(t) < p.q:
                self.short.add_word(t, self.short.get(t, ()) + (n,)) if t in self.short else self.short.add_word(t, (n,))
                continue
            v = qgrams(codes(t), p.q)
            owners.append(np.full(len(v), n, np.int64))
            values.append(v)
            places.append(np.arange(len(v)))
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.known, self.from_ = np.unique(self.value, return_index=True)
        self.often = np.diff(np.append(self.from_, len(self.value)))
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.known) * 64 + 1).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[(self.known >> self.shift).astype(np.int64)] = True
        self.longest = max(map(len, self.texts), default=0)
        self.size = np.array([min(len(t), p.window) for t in self.texts], np.int64)
        self.budget = np.array([p.budget(int(x)) for x in self.size], np.int64)
        self.need = np.array([p.needed(int(x)) for x in self.size], np.int64)
        self.short.make_automaton()

    def starts(self, item: int) -> np.ndarray:
        last = max(0, len(self.texts[item]) - self.p.window)
        return np.append(np.arange(0, last, self.p.step), last)


def aligned(windows: np.ndarray, text: np.ndarray, start: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """The fewest edits, with the place, of any of the windows (a row of codes each) in the text from about its start, along the diagonals within edits of any start in [start - edits, start + 2 edits]; None above the budget."""
    size, width = windows.shape[1], 5 * edits + 2
    lo = np.minimum(np.maximum(0, start - edits), len(text))
    # a code that no text has: replacing it costs as much as leaving out the window's
    padded = np.append(text, np.full(size + width + 1, 0xFFFFFFFF, np.uint32))
    region = padded[lo[:, None] + np.arange(size + width + 1)]
    # row i of each table, at diagonals d = column - i, from 0 to width; free start on all diagonals
    idx = np.arange(width + 1, dtype=np.int16)
    cost = np.zeros((len(windows), width + 1), np.int16)
    origin = np.broadcast_to(idx, cost.shape)
    for i in range(size):
        new = cost + (region[:, i : i + width + 1] != windows[:, i : i + 1])
        from_ = origin.copy()
        up = cost[:, 1:] + np.int16(1)
        better = up < new[:, :-1]
        new[:, :-1][better] = up[better]
        from_[:, :-1][better] = origin[:, 1:][better]
        cost = np.minimum.accumulate(new - idx, axis=1) + idx
        at = np.maximum.accumulate(np.where(cost == new, idx, np.int16(0)), axis=1)
        origin = np.take_along_axis(from_, at.astype(np.int64), 1)
        if i % 8 == 7:
            ok = cost.min(1) <= edits
            if not ok.any():
                return None
            if not ok.all():
                cost, origin, region, windows, lo = cost[ok], origin[ok], region[ok], windows[ok], lo[ok]
    d = cost.argmin(1)
    rows = np.arange(len(cost))
    least = cost[rows, d]
    k = int(least.argmin())
    if least[k] > edits:
        return None
    begin = int(lo[k])
    return int(least[k]), begin + int(origin[k, d[k]]), min(len(text), begin + size + int(d[k]))


def segments(hits: np.ndarray, overlap: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places of at most so many hits (or of 4 overlaps), each but the first beginning an overlap before the end of the one before."""
    total = np.append(0, np.cumsum(hits))
    start = 0
    while True:
        end = min(len(hits), max(start + 4 * overlap, int(np.searchsorted(total, total[start] + most, side="right")) - 1))
        yield start, end
        if end >= len(hits):
            return
        start = end - overlap


def found_in(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best verified window of each text and item: the fewest edits, then the first place."""
    p = items.p
    plain = [normal(t) for t in texts]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(items.known):
        glued = codes("\0".join(plain))
        length = np.array([len(t) for t in plain], np.int64) + 1
        first = np.cumsum(length) - length
        v = qgrams(glued, p.q)
        at = np.flatnonzero(items.maybe[(v >> items.shift).astype(np.int64)])
        k = np.searchsorted(items.known, v[at])
        ok = items.known[np.minimum(k, len(items.known) - 1)] == v[at]
        at, k = at[ok], k[ok]
        # a window with its edits lies in one segment at least, so memory follows the segment and not the text
        hits = np.zeros(len(glued), np.int64)
        hits[at] = items.often[k]
        overlap = int(items.size.max() + 2 * items.budget.max()) + p.q
        for lo, hi in segments(hits, overlap, p.most_hits):
            here = slice(*np.searchsorted(at, [lo, hi]))
            _verified(plain, glued, first, at[here], k[here], items, best)
    if len(items.short):
        for t, x in enumerate(plain):
            for end, owners in items.short.iter(f" {x} "):
                for item in owners:
                    n = len(items.texts[item])
                    y = f" {x} "
                    if y[end - n] == " " and y[end + 1] == " ":
                        best.setdefault((t, item), (0, end - n, end))
    for (t, item), (edits, s, e) in sorted(best.items()):
        yield t, item, edits, s, e


def _verified(plain: list[str], glued: np.ndarray, first: np.ndarray, at: np.ndarray, k: np.ndarray, items: Items, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Adds to best what the q-grams k of the index at the places at verify."""
    p = items.p
    if len(at):
        often = items.often[k]
        place = np.repeat(at, often)
        entry = np.repeat(items.from_[k], often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        item = items.owner[entry]
        text = np.searchsorted(first, place, side="right") - 1
        inner = items.place[entry]
        diagonal = place - first[text] - inner + items.longest
        # an item found as it stands can't be found better further on
        done = np.array([t * len(items.texts) + n for (t, n), x in best.items() if not x[0]], np.int64)
        ok = ~np.isin(text * len(items.texts) + item, done)
        text, item, inner, diagonal, place = text[ok], item[ok], inner[ok], diagonal[ok], place[ok]
        # too few hits of the item in the text for any window
        _, pair, total = np.unique(text * len(items.texts) + item, return_inverse=True, return_counts=True)
        ok = total[pair] >= items.need[item]
        text, item, inner, diagonal = text[ok], item[ok], inner[ok], diagonal[ok]
        order = np.lexsort((inner, diagonal, item, text))
        text, item, inner, diagonal = text[order], item[order], inner[order], diagonal[order]
        span = items.size[item] - p.q
        to = np.minimum(np.arange(len(text)) + span, len(text) - 1)
        whole = (np.arange(len(text)) + span < len(text)) & (text[to] == text) & (item[to] == item) & (diagonal[to] == diagonal) & (inner[to] - inner == span)
        if p.step > 1:
            whole &= (inner % p.step == 0) | (inner == np.array([len(t) for t in items.texts], np.int64)[item] - items.size[item])
        for h in np.flatnonzero(whole).tolist():
            t, n, a = int(text[h]), int(item[h]), int(inner[h])
            s, size = int(diagonal[h]) - items.longest + a, int(items.size[n])
            if (0, s) < best.get((t, n), (1,))[:2] and plain[t][s : s + size] == items.texts[n][a : a + size]:
                best[t, n] = (0, s, s + size)
        half = items.budget[item] + 1
        held: tuple[int, np.ndarray] = (-1, glued[:0])
        for phase in (0, 1):
            band = (diagonal + phase * half) // (2 * half)
            order = np.lexsort((inner, band, item, text))
            key = np.stack([text, item, band], 1)[order]
            places = inner[order]
            new = np.append(True, (key[1:] != key[:-1]).any(1)) if len(key) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            # need hits within a window's length
            to = np.arange(len(key)) + items.need[key[:, 1]] - 1
            inside = np.minimum(to, len(key) - 1)
            ok = (to < len(key)) & (group[inside] == group) & (places[inside] - places <= items.size[key[:, 1]] - p.q)
            end = np.append(start[1:], len(key))
            for g in np.unique(group[ok]).tolist():
                t, n, b = (int(x) for x in key[start[g]])
                if best.get((t, n), (1, 0, 0))[0] == 0:
                    continue
                edits, size = int(items.budget[n]), int(items.size[n])
                hits = places[start[g] : end[g]]
                s = items.starts(n)
                s = s[np.searchsorted(hits, s + size - p.q, side="right") - np.searchsorted(hits, s) >= items.need[n]]
                if held[0] != t:
                    held = (t, codes(plain[t]))
                low = b * 2 * (edits + 1) - phase * (edits + 1) - items.longest
                every = np.lib.stride_tricks.sliding_window_view(codes(items.texts[n]), size)
                for part in range(0, len(s), 1000):
                    x = s[part : part + 1000]
                    got = aligned(every[x], held[1], np.maximum(0, low + x), edits)
                    if got and got < best.get((t, n), (1 << 20, 0, 0)):
                        best[t, n] = got


def _leaks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch["text"])
        for a, b in steps(texts, 2_000_000):
            rows = list(found_in(texts[a:b], items))
            at = pa.array([a + r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(at), "item": pa.array([r[1] for r in rows], pa.int64()), "edits": pa.array([r[2] for r in rows], pa.int32()), "start": pa.array([r[3] for r in rows], pa.int32()), "end": pa.array([r[4] for r in rows], pa.int32()), "tk": batch["tk"].take(at)})


def leaks(docs: DataFrame, benchmark: DataFrame, p: LeakSearch = LeakSearch()) -> DataFrame:
    """Rows doc_id, item_id, edits, start, end (of the best region, in the normalised text), tk (xxhash64 of the text)."""
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // p.block_chars) + 1
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("tk"))
    parts = []
    for n in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).distinct().orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Items(list(zip(block["item_id"].to_pylist(), block["text"].to_pylist(), strict=True)), p))
        # from an Arrow table: a list of rows would go through Python workers of its own kind, which stay as well
        ids = spark.createDataFrame(block.select(["item_id"]).append_column("item", pa.array(range(block.num_rows), pa.int64())))
        found = rows.mapInArrow(lambda it, s=shared: released(_leaks(it, s.value)), f"doc_id {kind}, item long, edits int, start int, end int, tk long")
        parts.append(found.join(ids, "item").drop("item"))
    return reduce(DataFrame.unionByName, parts).select("doc_id", "item_id", "edits", "start", "end", "tk")


def clean(docs: DataFrame, benchmark: DataFrame, p: LeakSearch = LeakSearch()) -> DataFrame:
    """The rows of docs without a leak."""
    own, key = fresh(docs, "id"), fresh(docs, "tk")
    bad = leaks(docs, benchmark, p).select(F.col("doc_id").alias(own), F.col("tk").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key)), "left_anti")
