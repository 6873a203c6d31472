"""Very many equal rows of one id, and very repetitive texts: bounded memory, linear time, the same results."""

import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import licenses, ngram_join, quality, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(n))


def test_a_hundred_thousand_rows_of_one_labelled_id(spark):
    many = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("some plain words here").alias("text"))
    rest = docs(spark, [(i, words(i, 30)) for i in range(4, 60)]).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(3, 60)] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    for column in ("toxic", "quality"):
        got = toxicity.labelled(many.unionByName(rest), labels, column, 1_000)
        assert got.count() == got.select("text").distinct().count() <= 57
        assert got.filter("text = 'some plain words here'").count() <= 1
    assert quality.fit(many.unionByName(rest), labels).mean.shape == (quality.WIDTH,)


def test_one_text_of_several_under_an_id(spark):
    two = docs(spark, [(i, t) for i in range(3, 12) for t in ("first", "second", None)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(3, 12)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(two, labels, "toxic", 100).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(3, 12)) > 0


def test_equal_rows_with_a_near_copy_are_compared_once(spark):
    base = words(1, 80)
    near = base.rsplit(" ", 1)[0] + " other"
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(base).alias("text"))
    df = many.unionByName(docs(spark, [(2, near), (9, words(2, 80))]).select("doc_id", "text"))
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.classes(df).collect()}
    assert got == {(1, 1, 20_000, 20_000), (2, 1, 20_000, 1), (9, 9, 0, 1)}
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == [1, 9]


def test_equal_rows_lose_a_passage_once(spark):
    passage = words(5, 70)
    rows = [(1, passage + ". " + words(6, 40))] + [(7, words(8, 40) + ". " + passage)] * 3_000
    out = substring_dedup.dedup(docs(spark, rows), substring_dedup.WHOLE).filter("doc_id = 7").groupBy("text").agg(F.count("*").alias("n"), F.first("_ranges").alias("r")).collect()
    assert len(out) == 1 and out[0]["n"] == 3_000 and passage.split()[30] not in out[0]["text"] and len(out[0]["r"]) == 1


def test_finished_shuffles_leave_the_disk(spark):
    passage = words(5, 70)
    df = docs(spark, [(i, words(100 + i, 40) + ". " + passage) for i in range(40)])

    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffles()
    out = substring_dedup.dedup(df, substring_dedup.WHOLE)
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.filter(F.size("_ranges") > 0).count() == 39


def plain_windows(at, values, reach, whole, least):
    out, last = [], -1
    for s in at:
        if s <= last:
            continue
        here = [k for k, x in enumerate(at) if s <= x <= s + reach]
        share = len({values[k] for k in here}) / whole
        if share >= least:
            out.append((s, at[here[-1]], share))
            last = at[here[-1]]
    return out


def test_license_windows_equal_plain():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(0, 60)
        at = sorted(r.sample(range(120), n))
        values = [r.randint(0, 12) for _ in at]
        args = (r.randint(1, 40), r.randint(1, 14), r.choice([0.3, 0.6, 0.9]))
        assert licenses.contained(np.array(at, np.int64), np.array(values, np.int64), *args) == plain_windows(at, values, *args)


def test_half_a_notice_repeated_two_million_characters(spark):
    half = " ".join(next(iter(licenses.TEMPLATES.values()))[0].split()[: 40])
    took = []
    for n in (500_000, 2_000_000):
        text = (half + " ") * (n // (len(half) + 1))
        began = time.process_time()
        licenses.matches([text], licenses.Library(licenses.TEMPLATES, licenses.LicenseScan()))
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.5) and took[1] < 60, took
