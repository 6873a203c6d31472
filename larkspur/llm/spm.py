"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The vocabulary is a merge model: a sequence of pieces is the encoding of a text
just when every two neighbours are the encoding of their concatenation. So an
encoding is the one path of finite weight in a max-plus automaton whose states
are (last piece, where it ends), with weight 0 for a valid neighbour and minus
infinity else; whether neighbours are valid is found by the vocabulary's merges.
A text is split into chunks of chunk characters; each chunk yields the transfer
matrix from the states in which a path may enter it to those in which it may
leave it. Matrices combine associatively; the combined prefix gives the state
each chunk is entered in, and every chunk is traced back by itself from that
state. A text of one chunk has nothing to combine: it is traced where it is.

Between two characters that stand side by side in no piece of the vocabulary (as
a letter and the space after it) no piece lies across: the matrix has one state there, and the path between two
such places depends on the text between them only, so it is traced once for
equal stretches of a batch and remembered. Only the text from a chunk's border
to the next such place needs the matrix; a chunk without any has it throughout.
The library reads the model's file and does nothing else.

Pieces are never trained. The model's path is a parameter. Nulls: a null text
gives null ids, an empty text an empty list; null ids decode to a null text.
Decoding an encoding gives the text (the model normalises nothing but the space
that it puts in front; the sign U+2581 itself comes back as a space). Repeated
rows are encoded each; a column named _ids is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import cut, fresh, plus, ready, released
from larkspur.llm.words import steps

SPACE = "▁"
NEVER = float("-inf")
#: Stretches up to this length are remembered, and only the needed places of them are asked for.
SHORT = 64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Pieces:
    model: str = MODEL
    chunk: int = 32_768


class Automaton:
    """The pieces' automaton over a text in which spaces are U+2581, the one in front included."""

    def __init__(self, model: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: self.sp.get_score(i) for i in plain}
        self.packed = {x: np.int32(i).tobytes() for x, i in self.id.items()}
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if self.sp.is_byte(i)}
        self.longest = max(len(self.piece[i]) for i in plain)
        # characters of pieces by number, and which two stand side by side in some piece
        social = sorted({c for i in plain if len(self.piece[i]) > 1 for c in self.piece[i]})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in social]] = np.arange(1, len(social) + 1)
        self.joins = np.zeros((len(social) + 1, len(social) + 1), bool)
        for i in plain:
            c = self.number[[ord(x) for x in self.piece[i]]]
            self.joins[c[:-1], c[1:]] = True
        self._valid: dict[tuple[str, str], bool] = {}
        self._last: dict[str, str] = {}
        self._stretch: dict[str, bytes] = {}
        self.column = pa.array([bytes([self.byte[i]]) if i in self.byte else b"" if self.sp.is_control(i) else self.piece[i].replace(SPACE, " ").encode() for i in range(n)], pa.large_binary())
        self.byte_id = {v: k for k, v in self.byte.items()}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the model's rule: of all neighbours that make a piece those of the best score are joined first, of equal scores the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: self.score.get(parts[i] + parts[i + 1], NEVER))
            if self.score.get(parts[best] + parts[best + 1], NEVER) == NEVER:
                return parts
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def valid(self, a: str, b: str) -> bool:
        got = self._valid.get((a, b))
        if got is None:
            if len(self._valid) > 400_000:
                self._valid.clear()
            got = self._valid[a, b] = self.merged(a + b) == [a, b]
        return got

    def forget(self) -> None:
        """Drops what is remembered: it saves work inside a task, and next to none in the tasks after it."""
        self._valid.clear()
        self._last.clear()
        self._stretch.clear()

    def stretch(self, text: str) -> bytes:
        """The ids, of 32 bits each, of a text between two places that no piece lies across. The path to each place is the encoding of what stands before it, so one state a place has a finite weight: that of its last piece."""
        known = self._stretch.get(text)
        if known is not None:
            return known
        if len(text) <= SHORT:
            path = self.short(text)
        else:
            path, last, at = [], self.lasts(text), len(text)
            while at:
                path.append(last[at])
                at -= len(last[at])
        packed = self.packed
        got = b"".join([packed[x] if x in packed else np.array(self.ids([x]), np.int32).tobytes() for x in reversed(path)])
        if len(text) <= SHORT:
            if len(self._stretch) > 150_000:
                self._stretch.clear()
            self._stretch[text] = got
        return got

    def lasts(self, text: str) -> list[str]:
        """The last piece of the path to each place, from left to right."""
        ids, pairs, longest = self.id, self._valid, self.longest
        last = [""] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                x = text[start:end]
                if x in ids or end - start == 1:
                    if not start:
                        last[end] = x
                        break
                    ok = pairs.get((last[start], x))
                    if ok is None:
                        ok = self.valid(last[start], x)
                    if ok:
                        last[end] = x
                        break
        return last

    def short(self, text: str) -> list[str]:
        """The path through a short text. As lasts, but only the places that the end asks for: a place's pieces are tried longest first, and one that begins at a place not known yet asks for that place first. A place has one such piece, so the order doesn't matter; it depends on the text before the place only, so it is remembered for all texts that begin alike."""
        ids, pairs, longest, known = self.id, self._valid, self.longest, self._last
        if len(known) > 100_000:
            known.clear()
        n = len(text)
        # places asked for, each with the start of the piece to try next; a place asks for places before it only
        asked = [] if text in known else [(n, max(0, n - longest))]
        while asked:
            end, start = asked.pop()
            for at in range(start, end):
                x = text[at:end]
                if x in ids or end - at == 1:
                    if not at:
                        break
                    before = known.get(text[:at])
                    if before is None:
                        asked += (end, at), (at, max(0, at - longest))
                        x = ""
                        break
                    ok = pairs.get((before, x))
                    if ok is None:
                        ok = self.valid(before, x)
                    if ok:
                        break
            if x:
                known[text[:end]] = self.piece[ids[x]] if x in ids else x
        path = []
        while n:
            path.append(x := known[text[:n]])
            n -= len(x)
        return path

    def traced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that begin and end at such places, one after the other, and how many each has."""
        glued = "".join(texts)
        if not glued:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        point = np.frombuffer(glued.encode("utf-32-le"), np.uint32)
        number = self.number[point]
        apart = np.append(~self.joins[number[:-1], number[1:]], True)
        apart[ends[ends > 0] - 1] = True
        to = np.flatnonzero(apart) + 1
        counts = np.diff(np.append(0, np.searchsorted(to, ends, side="right")))
        # the stretches are an Arrow column over the text's bytes; only different ones become Python's
        size = 1 + (point >= 0x80).astype(np.int8) + (point >= 0x800) + (point >= 0x10000)
        cuts = np.append(0, np.cumsum(size, dtype=np.int64)[to - 1])
        coded = pa.LargeStringArray.from_buffers(len(to), pa.py_buffer(cuts), pa.py_buffer(glued.encode())).dictionary_encode()
        known = self._stretch
        parts = [known.get(x) or self.stretch(x) for x in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        size = sizes[code]
        to = np.cumsum(size)
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - (to - size), size) + np.arange(to[-1])
        total = np.append(0, to)[np.append(0, np.cumsum(counts))]
        return np.frombuffer(b"".join(parts), np.int32)[at], np.diff(total)

    def pieces_at(self, text: str, at: int) -> list[str]:
        found = [text[at : at + n] for n in range(2, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.id]
        return [text[at : at + 1], *found]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for x in pieces:
            if x in self.id:
                out.append(self.id[x])
            else:
                out += [self.byte_id[v] for v in x.encode()]
        return out

    def calm(self, text: str, at: int) -> bool:
        """Whether no piece can lie across this place."""
        return at == 0 or at >= len(text) or not self.joins[self.number[ord(text[at - 1])], self.number[ord(text[at])]]


@lru_cache(maxsize=2)
def automaton(model: str) -> Automaton:
    return Automaton(model)


#: A state: the last piece and how far after the chunk's border it ends. "" before the first piece and wherever the last piece doesn't matter.
State = tuple[str, int]
Matrix = dict[State, dict[State, float]]


def entries(a: Automaton, text: str, at: int) -> list[State]:
    """The states in which a path may pass a border."""
    if a.calm(text, at):
        return [("", 0)]
    out = []
    for s in range(max(0, at - a.longest), at):
        out += [(x, s + len(x) - at) for x in a.pieces_at(text, s) if s + len(x) >= at]
    return out


def walk(a: Automaton, text: str, start: int, end: int, state: State) -> dict[State, list[tuple[str, int]]]:
    """From a state at the border start, for each state at the border end that a valid path reaches, that path's (piece, place) from start on. Max-plus: all weights are 0, so any path of finite weight is best."""
    at = start + state[1]
    if at > end or at == end and not a.calm(text, end) and state[0]:
        return {(state[0], at - end): []} if at >= end else {}
    if at == end:
        return {("", 0) if a.calm(text, end) else (state[0], 0): []}
    back: dict[tuple[str, int], tuple[str, int] | None] = {(state[0], at): None}
    open_: dict[int, list[str]] = {at: [state[0]]}
    done: list[tuple[str, int]] = []
    while open_:
        here = min(open_)
        before = open_.pop(here)
        forget = a.calm(text, here)
        for x in a.pieces_at(text, here):
            to = here + len(x)
            if (x, to) in back:
                continue
            for b in before:
                if not b or forget or a.valid(b, x):
                    back[x, to] = (b, here)
                    if to >= end:
                        done.append((x, to))
                    else:
                        open_.setdefault(to, []).append(x)
                    break
    out: dict[State, list[tuple[str, int]]] = {}
    for node in done:
        leave = ("", 0) if node[1] == end and a.calm(text, end) else (node[0], node[1] - end)
        path, x = [], node
        while back[x] is not None:
            b = back[x]
            path.append((x[0], b[1]))
            x = b
        out[leave] = path[::-1]
    return out


def inner(a: Automaton, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and last place in a chunk that no piece lies across."""
    first = next((i for i in range(start, end) if a.calm(text, i)), None)
    if first is None:
        return None
    return first, next(i for i in range(end, first - 1, -1) if a.calm(text, i))


def transfer(a: Automaton, text: str, start: int, end: int) -> Matrix:
    """A chunk's matrix: weight 0 where a valid path leads from an entering to a leaving state; what isn't listed is minus infinity."""
    calm = inner(a, text, start, end)
    rows: Matrix = {}
    if calm is None:
        for s in entries(a, text, start):
            rows[s] = dict.fromkeys(walk(a, text, start, end, s), 0.0)
        return {k: v for k, v in rows.items() if v}
    left = {s: walk(a, text, start, calm[0], s) for s in entries(a, text, start)}
    right = dict.fromkeys(walk(a, text, calm[1], end, ("", 0)), 0.0) if calm[1] < end else {("", 0): 0.0}
    return {s: right for s, to in left.items() if ("", 0) in to}


def times(x: Matrix, y: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for s, row in x.items():
        new: dict[State, float] = {}
        for mid, w in row.items():
            for t, v in y.get(mid, {}).items():
                new[t] = max(new.get(t, NEVER), w + v)
        if new:
            out[s] = new
    return out


def trace(a: Automaton, text: str, start: int, end: int, enter: State, leave: State) -> np.ndarray:
    """The ids of the chunk's own pieces: those that begin in it."""
    calm = inner(a, text, start, end)
    if calm is None:
        return np.array(a.ids([x for x, _ in walk(a, text, start, end, enter)[leave]]), np.int32)
    head = [x for x, _ in walk(a, text, start, calm[0], enter)[("", 0)]] if calm[0] > start else []
    tail = [x for x, _ in walk(a, text, calm[1], end, ("", 0))[leave]] if calm[1] < end else []
    return np.concatenate([np.array(a.ids(head), np.int32), a.traced([text[calm[0] : calm[1]]])[0], np.array(a.ids(tail), np.int32)])


def lists(parts: list[np.ndarray | None]) -> pa.Array:
    """An Arrow column of lists of ids."""
    size = np.array([0 if x is None else len(x) for x in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(x for x in parts if x is not None)]).astype(np.int32)
    missing = np.array([x is None for x in parts], bool)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(missing) if missing.any() else None)


def borders(length: int, chunk: int) -> list[int]:
    return [*range(0, max(1, length - chunk // 2), chunk), length]


# a chunk's row has the text around it, so that it can be read without the others
def _chunks(batches: Iterator[pa.RecordBatch], p: Pieces) -> Iterator[pa.RecordBatch]:
    pad = automaton(p.model).longest + 1
    for batch in batches:
        for row, text in zip(batch["_row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = SPACE + text.replace(" ", SPACE)
            cuts = borders(len(text), p.chunk)
            for n, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                lo = max(0, s - pad)
                yield pa.RecordBatch.from_pydict({"_row": pa.array([row], pa.int64()), "n": pa.array([n], pa.int32()), "around": pa.array([text[lo : e + pad]], pa.string()), "s": pa.array([s - lo], pa.int32()), "e": pa.array([e - lo], pa.int32())})


def _transfers(batches: Iterator[pa.RecordBatch], p: Pieces) -> Iterator[pa.RecordBatch]:
    a = automaton(p.model)
    for batch in batches:
        found = [dump(transfer(a, t, s, e)) for t, s, e in zip(batch["around"].to_pylist(), batch["s"].to_pylist(), batch["e"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"_row": batch["_row"], "n": batch["n"], "matrix": pa.array(found, pa.string())})
    a.forget()


def _borders(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("n")
    found = scan([load(x) for x in rows["matrix"].to_pylist()])
    return pa.table({"_row": rows["_row"], "n": rows["n"], "enter": pa.array([x[0][0] for x in found], pa.string()), "enter_at": pa.array([x[0][1] for x in found], pa.int32()), "leave": pa.array([x[1][0] for x in found], pa.string()), "leave_at": pa.array([x[1][1] for x in found], pa.int32())})


def _traces(batches: Iterator[pa.RecordBatch], p: Pieces) -> Iterator[pa.RecordBatch]:
    a = automaton(p.model)
    for batch in batches:
        ids = [trace(a, r["around"], r["s"], r["e"], (r["enter"], r["enter_at"]), (r["leave"], r["leave_at"])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"_row": batch["_row"], "n": batch["n"], "ids": lists(ids)})
    a.forget()


def dump(m: Matrix) -> str:
    return json.dumps([[k, [[t, w] for t, w in v.items()]] for k, v in m.items()])


def load(x: str) -> Matrix:
    return {(k[0], k[1]): {(t[0], t[1]): w for t, w in v} for k, v in json.loads(x)}


def encode_text(text: str, p: Pieces = Pieces()) -> list[int]:
    """One text on one machine, by the same scan."""
    a = automaton(p.model)
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    cuts = borders(len(text), p.chunk)
    ids: list[int] = []
    for s, e, (enter, leave) in zip(cuts, cuts[1:], scan([transfer(a, text, s, e) for s, e in zip(cuts, cuts[1:], strict=False)]), strict=False):
        ids += trace(a, text, s, e, enter, leave).tolist()
    return ids


def scan(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """For each chunk the states in which the path of finite weight enters and leaves it: products of all that precede, by doubling strides (a Hillis-Steele scan), and of all that follow."""
    n = len(matrices)
    prefix, suffix = list(matrices), list(matrices)
    stride = 1
    while stride < n:
        prefix = [times(prefix[i - stride], prefix[i]) if i >= stride else prefix[i] for i in range(n)]
        suffix = [times(suffix[i], suffix[i + stride]) if i + stride < n else suffix[i] for i in range(n)]
        stride *= 2
    border: list[State] = [("", 0)]
    for i in range(n - 1):
        after = suffix[i + 1]
        border.append(next(s for s in prefix[i][("", 0)] if ("", 0) in after.get(s, {})))
    border.append(("", 0))
    return list(zip(border, border[1:], strict=False))


def _single(batches: Iterator[pa.RecordBatch], p: Pieces) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: both its borders are the text's, so its matrix is the one state that it is traced from."""
    a = automaton(p.model)
    for batch in batches:
        texts = batch["text"].to_pylist()
        for k, e in steps([t or "" for t in texts], 1_000_000):
            part = texts[k:e]
            values, sizes = a.traced([SPACE + t.replace(" ", SPACE) if t else "" for t in part])
            missing = np.array([t is None for t in part], bool)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values), mask=pa.array(missing) if missing.any() else None)
            yield pa.RecordBatch.from_pydict({c: batch[c].slice(k, e - k) for c in batch.schema.names} | {"_ids": ids})
    a.forget()


def encode(docs: DataFrame, p: Pieces = Pieces()) -> DataFrame:
    """docs with _ids, the piece ids of text. Texts of several chunks are dealt by chunk; a text is one row, so what a task holds of it at once, its matrices, is a hundredth of what a row holds."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("_ids")
    key = fresh(docs, "row")
    schema = plus(docs, "_ids array<int>")
    giant = F.coalesce(F.length("text") + 1 > p.chunk + p.chunk // 2, F.lit(False))
    whole = docs.filter(~giant).mapInArrow(lambda it: released(_single(it, p)), schema)
    rows = cut(docs.filter(giant).withColumn(key, F.monotonically_increasing_id()))
    if rows.isEmpty():
        return whole
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.select(F.col(key).alias("_row"), "text").mapInArrow(lambda it: released(_chunks(it, p)), "_row long, n int, around string, s int, e int").repartition(n, "_row", "n")
    matrices = chunks.mapInArrow(lambda it: released(_transfers(it, p)), "_row long, n int, matrix string")
    states = matrices.groupBy("_row").applyInArrow(_borders, "_row long, n int, enter string, enter_at int, leave string, leave_at int")
    ids = chunks.join(states, ["_row", "n"]).mapInArrow(lambda it: released(_traces(it, p)), "_row long, n int, ids array<int>")
    ids = ids.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("_ids"))
    return whole.unionByName(rows.join(ids.withColumnRenamed("_row", key), key).select(*schema.names))


def joined(a: Automaton, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts of ids, one after the other, and where each begins (and the end). The space that the encoding put in front goes."""
    if not len(values):
        return np.zeros(0, np.uint8), at
    taken = a.column.take(pa.array(values))
    starts = np.frombuffer(taken.buffers()[1], np.int64, len(values) + 1)[at]
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: starts[-1]]
    some = starts[:-1][np.diff(starts) > 0]
    space = some[data[some] == 32]
    return np.delete(data, space), starts - np.searchsorted(space, starts)


def _decode(batches: Iterator[pa.RecordBatch], p: Pieces, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    a = automaton(p.model)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            column = part[ids]
            at = column.offsets.to_numpy()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            data, starts = joined(a, column.values.to_numpy()[at[0] : at[-1]], (at - at[0]).astype(np.int64))
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(starts), pa.py_buffer(data)])
            try:
                texts = found.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # ids that no text has
                texts = pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
            texts = texts if known.all() else pc.if_else(pa.array(known), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_pydict({c: part[c] for c in part.schema.names} | {out: texts})


def decode(df: DataFrame, p: Pieces = Pieces(), ids: str = "_ids", out: str = "_decoded") -> DataFrame:
    """df with the text that the ids stand for."""
    ready(df.sparkSession)
    df = df.drop(out)
    return df.mapInArrow(lambda it: released(_decode(it, p, ids, out)), plus(df, f"{out} string"))
