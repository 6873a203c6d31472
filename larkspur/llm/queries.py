"""A query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, fill_middle, html_extract, licenses, media, ngram_join, quality, sharding, spm, substring_dedup, toxicity, url_filters, whitening
from larkspur.llm.shared import held_out, remove, shared_folder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose repeated sentences or passages of 50 words: what goes, where, and which documents keep it."""
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"), substring_dedup.WHOLE).filter(F.size("_ranges") > 0)
    gone = F.aggregate("_ranges", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", F.col("_firsts").alias("first_doc_ids"), F.col("_ranges").alias("removed"), gone.alias("removed_chars"), F.length("text").alias("left_chars"), F.sha2("text", 256).alias("text_sha256"))


#: The rules of the query's contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality that labels gives its number."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("label"))
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels, RULES)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: a row for each document and benchmark item whose text it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = toxicity.ToxicityFit()
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels"), p))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= p.threshold).cast("int").alias("predicted"), F.col("_hits").alias("hits"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spm.decode(spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    same = F.col("_decoded").eqNullSafe(F.replace("text", F.lit(spm.SPACE), F.lit(" ")))
    return ids.select("doc_id", F.size("_ids").alias("n_pieces"), F.col("_ids").alias("token_ids"), F.sha2("_decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each license notice found in a document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page with one figure between its words, whose payload is the document's text. The payloads are stored in the shared folder and read from there; the page's reference is resolved by its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = media.media_digest(F.col("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    page = F.concat(F.lit("<p>document "), name, F.lit('</p><figure><img src="media:'), digest, F.lit('"><figcaption>text of document '), name, F.lit("</figcaption></figure><p>end</p>"))
    pages = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), page.alias("html"))
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    out = media.resolve(media.sequences(pages), media.stored_in(media.store(docs), folder))
    remove(spark, folder)  # the facts are cut from it
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", F.col("kept_key").alias("kept"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = quality.QualityFit()
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), p))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= p.threshold).cast("int").alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component. deviation is null where it leaves 64 bits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = whitening.fit(e)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return spark.createDataFrame([], schema)
    rows = whitening.whiten(e, w).select("vec_id", F.col("_deviation").try_cast("long").alias("deviation"), F.posexplode("_whitened").alias("pos", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in w.explained])[F.col("pos")]
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(whitening.identity_error(e, w)).alias("identity_error"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous in doc_id's order; equal texts lie where their ids put them, as shards of near equal bytes can't hold a group of a third of all rows whole."""
    out = sharding.shard(table(spark, sf_dir, "documents"), sharding.Shards(8))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.arrange(table(spark, sf_dir, "documents").select("doc_id", "text")))
    chars = lambda c: F.length(c).cast("long")
    return out.select(
        "doc_id", F.col("_units").alias("n"), F.col("_form").alias("form"), chars("_prefix").alias("prefix_chars"), chars("_middle").alias("middle_chars"),
        F.sha2("_output", 256).alias("output_sha256"), F.sha2("_restored", 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_url_filters, op3_benchmark_decontamination, op4_toxicity, op5_sentencepiece, op6_license_scans, op7_media_columns, op8_ngram_jaccard_join, op9_html_extraction, op10_quality_classifier, op11_embedding_whitening, op12_sharding, op13_fill_in_middle)
}
#: The others can't be stated in SQL at a bearable cost; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_sharding": """
WITH bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc_of FROM range(256) t(i)),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM d, bits),
o AS (SELECT *, row_number() OVER w AS i, sum(size) OVER w AS ends, sum(size) OVER () AS whole FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST((2 * ends - size) * 8 // (2 * whole) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, i - min(i) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS x, coalesce(array_to_string(units[a + 1:b], ''), '') AS y, coalesce(array_to_string(units[b + 1:n], ''), '') AS z FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END AS out FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN out WHEN 'psm' THEN split_part(out[4:], '<S>', 1) || split_part(out, '<M>', 2) || split_part(split_part(out, '<M>', 1), '<S>', 2)
  ELSE split_part(split_part(out, '<M>', 1), '<P>', 2) || split_part(out, '<M>', 2) || split_part(out[4:], '<P>', 1) END AS back FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars, sha256(out) AS output_sha256, sha256(back) AS restored_sha256 FROM r""",
}
