"""Media columns: pages as ordered sequences of text and media references, with payloads resolved by digest.

sequences() parses HTML into an array of structs in page order: position, kind
(text or media), text, reference and caption. A reference is the digest in a
source "media:<sha256>", or the source itself. Captions are the figcaption of
the media's own figure, else its alt text. resolve() joins references with a
table of payload facts on the digest; positions and captions stay with their
references. Facts are computed once per stored payload, before the join, and
only they are shuffled, never the payloads.

A payload is stored as 8-bit grey samples, 64 a row, in the binary PGM format:
the bytes, then bytes 0 up to a positive multiple of 64.

Nulls: a null html is a page without parts; a null text is an empty payload
(64 bytes 0). A reference without a payload has null facts. Equal payloads are
one stored object.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.dom import attributes, parse
from larkspur.llm.shared import cut, plus, ready
from larkspur.llm.words import strings

ROW = 64
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")
FACTS = "digest string, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
PART = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (ROW if not data else 0))


def stored(payload: bytes) -> bytes:
    """The payload as a PGM picture of one sample a byte."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def read_back(media: bytes) -> bytes:
    m = _HEADER.match(media)
    if not m:
        raise ValueError("not an 8-bit binary PGM")
    n = int(m[1]) * int(m[2])
    samples = media[m.end() : m.end() + n]
    if len(samples) != n:
        raise ValueError("the picture is cut short")
    return samples


def feature(payload: bytes) -> str:
    """Statistics of the samples, to fixed decimals: mean, deviation, entropy, share of zeros, mean step from row to row."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    p = hist[hist > 0] / len(x)
    v = np.arange(256)
    mean = float((hist * v).sum() / len(x))
    deviation = float(np.sqrt(max(0.0, (hist * v * v).sum() / len(x) - mean * mean)))
    rows = x.reshape(-1, ROW).astype(np.int16)
    step = float(np.abs(np.diff(rows, axis=0)).mean()) if len(rows) > 1 else 0.0
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zeros={hist[0] / len(x):.4f};step={step:.4f}"


def media_digest(text: Column) -> Column:
    """The digest of the stored form of a text's bytes."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    rows = F.greatest(F.ceil(n / F.lit(ROW)), F.lit(1)).cast("int")
    zeros = F.unhex(F.repeat(F.lit("00"), rows * ROW - n))
    return F.sha2(F.concat(F.encode(F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8"), raw, zeros), 256)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [stored(padded(t.encode())) for t in strings(batch["text"])]
        yield pa.RecordBatch.from_pydict({"media": pa.array(media, pa.binary())})


def store(docs: DataFrame) -> DataFrame:
    """The stored form of each text: one binary column, media."""
    ready(docs.sparkSession, 500)
    return docs.select("text").mapInArrow(_store, "media binary")


def stored_in(media: DataFrame, folder: str) -> DataFrame:
    """The stored forms written to a folder that all executors see, and read from there."""
    media.write.option("compression", "zstd").parquet(folder)
    return media.sparkSession.read.parquet(folder)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("digest", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")}
        for m in batch["media"].to_pylist():
            payload = read_back(m)
            for k, v in zip(out, (hashlib.sha256(m).hexdigest(), len(m), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature(payload)), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out)


def facts(media: DataFrame) -> DataFrame:
    """One row for each different stored object: its digest and what is read back from it."""
    ready(media.sparkSession, 500)
    return media.filter("media IS NOT NULL").mapInArrow(_facts, FACTS).dropDuplicates(["digest"])


def parts(page: str) -> list[dict]:
    dom = parse(page)
    figure, captions = {}, {}
    for k in range(1, len(dom.tag)):
        up = figure.get(dom.parent[k])
        figure[k] = k if dom.tag[k] == "figure" else up
        if dom.tag[k] == "figcaption" and up:
            captions[k] = up
    inside: dict[int, int] = {}
    for k in range(1, len(dom.tag)):
        inside[k] = k if k in captions else inside.get(dom.parent[k], 0)
    said: dict[int, list[str]] = {}
    for e, t, _ in dom.texts:
        if inside.get(e):
            said.setdefault(captions[inside[e]], []).append(t)
    clean = lambda x: " ".join(entities.unescape(x).split())
    out: list[dict] = []
    current: list[str] = []
    block = None

    def flush() -> None:
        if text := clean("".join(current)):
            out.append({"position": len(out), "kind": "text", "text": text, "ref": None, "caption": None})
        current.clear()

    waiting = list(dom.media)
    for k in range(len(dom.texts) + 1):
        while waiting and waiting[0][1] <= k:
            flush()
            own = waiting.pop(0)[0]
            a = attributes(dom.attributes[own])
            source = entities.unescape(a.get("src") or a.get("data") or "")
            caption = clean("".join(said.get(figure.get(own) or -1, []))) or clean(a.get("alt", "")) or None
            out.append({"position": len(out), "kind": "media", "text": None, "ref": source.removeprefix("media:") or None, "caption": caption})
        if k < len(dom.texts):
            e, t, b = dom.texts[k]
            if inside.get(e):
                continue
            if b != block:
                flush()
                block = b
            current.append(t)
    flush()
    return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        found = [parts(x) if x else [] for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c != "html"} | {"_parts": pa.array(found, kind)})


def sequences(pages: DataFrame) -> DataFrame:
    """pages with _parts, the ordered sequence, in place of html."""
    ready(pages.sparkSession, 500)
    pages = pages.drop("_parts")
    return pages.mapInArrow(_sequences, plus(pages.drop("html"), f"_parts array<{PART}>"))


def resolve(pages: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each media reference of sequences(): the page's columns, position, caption, ref, and the facts of the payload with that digest, which is that of the stored bytes that were read."""
    refs = pages.withColumn("_part", F.explode("_parts")).drop("_parts").filter(F.col("_part.kind") == "media")
    refs = refs.select(*[c for c in refs.columns if c != "_part"], F.col("_part.position").alias("position"), F.col("_part.caption").alias("caption"), F.col("_part.ref").alias("ref"))
    # cut: so the join reads both sides from exchanges, and adaptive execution can split a hot digest
    return refs.join(cut(facts(media)), refs["ref"] == F.col("digest"), "left")
