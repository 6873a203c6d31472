"""Scalar expressions of the curation, partition, evaluation and accounting operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Rényi orders of the accountant.
RENYI_ORDERS = (1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 8.0, 16.0, 32.0, 64.0, 128.0)


def original_stem(stem: Column) -> Column:
    """What follows the first ___, trimmed and lower-cased."""
    at = F.instr(stem, "___")
    return F.trim(F.lower(F.when(at > 0, F.substr(stem, at + 3)).otherwise(stem)))


def leaf_of(candidates: Column, prefixes: list[str]) -> Column:
    """The candidate that belongs to one of the prefixes; null for none, an error for several."""
    own = F.filter(candidates, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, F.concat(p, F.lit(":::")))))
    return F.when(F.size(own) > 1, F.raise_error(F.concat(F.lit("several leaves: "), F.array_join(own, ", "))).cast("string")).when(F.size(own) == 1, own[0])


def namespaced_key(seed: int, namespace: str, key: Column) -> Column:
    """A portable pseudo-random order: the SHA-256 of seed:namespace:key."""
    return F.sha2(F.concat(F.lit(f"{seed}:{namespace}:"), key.cast("string")), 256)


def comma_list(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != "")
    return F.when(F.size(parts) > 0, parts)


def share(n: Column, total: Column) -> Column:
    return F.coalesce(n.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0))


def expected_flips(n: Column, fraction: float) -> Column:
    if fraction >= 1:
        return F.greatest(n, F.lit(0))
    return F.when(n <= 0, 0).otherwise(F.least(n, F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)))))).cast("long")


def n_correct(recall: Column, support: Column) -> Column:
    """Rounded half to even, within [0, support]."""
    return F.least(support, F.greatest(F.lit(0), F.bround(recall * support))).cast("long")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sign12(x: Column) -> Column:
    return F.signum(F.round(x, 12))


def log_support(n: Column) -> Column:
    return F.ln(F.greatest(n, F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """64 signs as the bits of a long, first entry highest."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def dhash(pixels: Column) -> Column:
    """64 bits of 8 rows of 9 grey pixels: left above right, row by row, first highest."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.get(pixels, k + F.floor(k / 8).cast("int")) > F.get(pixels, k + F.floor(k / 8).cast("int") + 1), 1.0).otherwise(-1.0))
    return sign_bits(bits)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def cross_entropy(logits: Column, target: Column) -> Column:
    top = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(logits, target)


def argmax(values: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """Structs (probability, class_index) of the k largest, ties by the lower index."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("minus"), i.alias("class_index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["minus"]).alias("probability"), s["class_index"].alias("class_index")))


def gaussian_rdp(steps: Column, order: Column, noise: Column) -> Column:
    return F.when(noise <= 0, F.lit(float("inf"))).otherwise(steps * order / (2.0 * noise * noise))


def rdp_to_epsilon(rdp: Column, order: Column, delta: Column) -> Column:
    """An order of 1 or below is an error."""
    return F.when(order > 1, rdp + F.ln(1.0 / delta) / (order - 1.0)).otherwise(F.raise_error(F.lit("orders must be above 1")).cast("double"))


def noise_stdv(noise: float, clip: float, clients: int) -> float:
    return noise * clip / clients


def expected_noise_l2(stdv: float, dimensions: int) -> float:
    return stdv * dimensions**0.5


def snr_bound(noise: float, clients: int, dimensions: int) -> float:
    return float("inf") if noise <= 0 else clients / (noise * dimensions**0.5)


def active(round_: Column, start: Column, end: Column) -> Column:
    """Whether a round lies in [start, end], without an upper bound where end is null."""
    return (round_ >= start) & (end.isNull() | (round_ <= end))


def flip_label(label: Column, selected: Column, is_active: Column, target: Column) -> Column:
    return F.when(is_active & selected, target).otherwise(label)


def phash(pixels: Column) -> Column:
    """64 bits of 32 x 32 grey pixels, row by row: whether each of the 8 x 8 lowest coefficients of the orthonormal DCT-II is above the median of the 63 others than the first."""
    basis = [[math.sqrt((1 if u == 0 else 2) / 32) * math.cos(math.pi * (2 * i + 1) * u / 64) for i in range(32)] for u in range(8)]
    table = F.array(*[F.array(*map(F.lit, row)) for row in basis])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lines = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(table, lambda c: dot(c, F.slice(pixels, i * 32 + 1, 32))))
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda v: F.transform(lines, lambda row: F.get(row, v)))
    coefs = F.flatten(F.transform(table, lambda c: F.transform(columns, lambda col: dot(c, col))))
    # each step is bound once, so the table isn't computed again for every bit
    return F.transform(F.array(coefs), lambda k: F.transform(F.array(F.array_sort(F.slice(k, 2, 63))[31]), lambda mid: sign_bits(F.transform(k, lambda x: x - mid)))[0])[0]
