"""Vectorised words, five-word shingles and MinHash values for batches of texts.

A word is a run between white space, lower-cased, without its characters that
are neither letters nor digits; what becomes empty that way is no word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

STEP_CHARS = 3_000_000
_DROP = re.compile(r"[^\w\n]+")
_END = re.compile(r"[.!?…]+[\"'»”’)\]]*$")
_CLOSING = frozenset(".!?…\"'»”’)]")
MUL = np.uint64(0x9E3779B97F4A7C15)
MUL_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def steps(texts: list[str], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, to bound memory."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class Words:
    """hash: a value for each word; first: where each text's words begin (one more entry than texts); ends: whether a word closes a sentence (it, or what follows it before the next word, has a sentence's end or stands last in its line); token: the word's index among its text's tokens (what str.split gives)."""

    def __init__(self, texts: list[str], sentences: bool = False) -> None:
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        breaks: list[int] = []
        for i, t in enumerate(texts):
            before = len(flat)
            if sentences and "\n" in t:
                for line in t.split("\n"):
                    flat += line.split()
                    breaks.append(len(flat) - 1)
            else:
                flat += t.split()
            counts[i] = len(flat) - before
        encoded = pa.array(flat, pa.large_string()).dictionary_encode()
        del flat
        unique = encoded.dictionary.to_pylist()
        values = np.zeros(len(unique), np.uint64)
        for k in range(0, len(unique), 5_000):  # many words at once, but no long copies of them; none has a line end
            plain = _DROP.sub("", "\n".join(unique[k : k + 5_000]).lower().replace("_", "-")).split("\n")
            part = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain)) | np.uint64(1)
            part[np.fromiter(map(len, plain), np.int64, len(plain)) == 0] = 0
            values[k : k + 5_000] = part
        code = encoded.indices.to_numpy(zero_copy_only=False)
        hashes = values[code] if len(code) else np.zeros(0, np.uint64)
        keep = hashes != 0
        text = np.repeat(np.arange(len(texts)), counts)
        self.hash = hashes[keep]
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(text[keep], minlength=len(texts)), out=self.first[1:])
        if sentences:
            closes = np.array([w[-1] in _CLOSING and _END.search(w) is not None for w in unique], bool)[code] if len(code) else np.zeros(0, bool)
            at = np.array(breaks, np.int64)
            closes[at[at >= 0]] = True
            # what stands between a word and the next counts for the word
            seen = np.concatenate([[0], np.cumsum(closes)])
            at = np.flatnonzero(keep)
            following = np.append(at[1:], len(keep))
            self.ends = seen[following] > seen[at]
            if len(at):
                self.ends[self.first[1:][np.diff(self.first) > 0] - 1] = True
            self.token = at - (np.cumsum(counts) - counts)[text[at]]


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text. Of fewer words than the size, all words make one; a text without words has the one shingle 0."""
    h = w.hash
    rolled = h.copy()
    for k in range(1, size):
        rolled = rolled[:-1] * MUL + h[k:] if len(rolled) > 1 else rolled[:0]
    rolled = mix(rolled)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            v = h[a : a + 1].copy()
            for k in range(a + 1, b):
                v = v * MUL + h[k : k + 1]
            out.append(mix(v ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(1, np.uint64))
    return out


class MinHash:
    """count values of 16 bits each, of independent multiplicative hashes."""

    def __init__(self, count: int, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.count = count
        self.mul = (r.integers(0, 2**31, count, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.xor = r.integers(0, 2**32, count, dtype=np.int64).astype(np.uint32)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        first = np.zeros(len(sets), np.int64)
        np.cumsum([len(s) for s in sets[:-1]], out=first[1:])
        out = np.empty((len(sets), self.count), np.uint16)
        for k in range(self.count):
            least = np.minimum.reduceat((flat ^ self.xor[k]) * self.mul[k], first)
            out[:, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by keys, tables of whole groups and where each group begins (and the end)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, count
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        change = np.zeros(n, bool)
        change[:1] = True
        for k in keys:
            v = table[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        to = n if last else int(starts[-1])
        if to:
            yield table.slice(0, to), np.append(starts[starts < to], to)
        rest = table.slice(to)
        held, count = rest.to_batches(), rest.num_rows

    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
            if count >= rows:
                yield from cut(False)
    if count:
        yield from cut(True)
