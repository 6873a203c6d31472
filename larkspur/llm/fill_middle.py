"""Fill-in-the-middle transformation of texts, in Spark SQL alone.

A text is cut into units (a run of letters, or any other single code point).
Two cuts between units, and whether and how the parts are arranged, come from
32-bit groups of a SHA-256 of the seed and the id, so every run and every
engine makes the same. The parts stand behind sentinels:

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text itself

A text that holds a sentinel stays plain, so in an arranged text the first
place of a sentinel, from the left, is the one that was put there: none of
them overlaps another or itself. `restore` needs the output and its form only.

It is a projection of each row: no shuffle, no Python. A null text is an empty
one and stays plain; a null id counts as no digits; repeated rows come out
alike; texts are never shortened. Columns named as the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The unit and the sentinels.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

ADDED = ["_units", "_form", "_prefix", "_middle", "_suffix", "_output"]


@dataclass(frozen=True)
class FillMiddle:
    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20


def _draw(digest: Column, n: int) -> Column:
    """The n-th group of 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, p: FillMiddle = FillMiddle()) -> DataFrame:
    """docs with _units (how many), _form, _prefix, _middle, _suffix (null where plain) and _output."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    out = docs.drop(*ADDED).withColumns({"_text": text, "_units": F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), "_digest": digest})
    n = F.size("_units").cast("long")
    holds = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    plain = (F.col("_text") == "") | holds | (_draw(F.col("_digest"), 2) % 100 >= 100 - p.plain_percent)
    a, b = _draw(F.col("_digest"), 0) % (n + 1), _draw(F.col("_digest"), 1) % (n + 1)
    out = out.withColumns({
        "_form": F.when(plain, "plain").when(_draw(F.col("_digest"), 3) % 100 < p.spm_percent, "spm").otherwise("psm"),
        "_from": F.least(a, b).cast("int"), "_to": F.greatest(a, b).cast("int"), "_n": n,
    })
    part = lambda start, length: F.when(F.col("_form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    out = out.withColumns({
        "_prefix": part(F.lit(1), F.col("_from")),
        "_middle": part(F.col("_from") + 1, F.col("_to") - F.col("_from")),
        "_suffix": part(F.col("_to") + 1, F.size("_units") - F.col("_to")),
    })
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    whole = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(F.col("_text"))
    kept = [c for c in docs.columns if c not in ADDED]
    return out.select(*kept, F.col("_n").alias("_units"), "_form", "_prefix", "_middle", "_suffix", whole.alias("_output"))


def restored(output: Column, form: Column) -> Column:
    """The text that was arranged, from the sentinels' first places."""

    def between(s: Column, left: str, right: str | None) -> Column:
        rest = F.substr(s, F.instr(s, left) + len(left))
        return F.substr(rest, F.lit(1), F.instr(rest, right) - 1) if right else rest

    psm = F.concat(between(output, PREFIX, SUFFIX), between(output, MIDDLE, None), between(output, SUFFIX, MIDDLE))
    spm = F.concat(between(output, PREFIX, MIDDLE), between(output, MIDDLE, None), between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(df: DataFrame) -> DataFrame:
    """df with _restored, from _output and _form."""
    return df.drop("_restored").withColumn("_restored", restored(F.col("_output"), F.col("_form")))
