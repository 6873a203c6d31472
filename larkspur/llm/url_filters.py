"""URL filters: rules first, then the purity of each host's path templates.

Digit runs and long hexadecimal runs of a path's segments become signs, and
equal paths of a host are counted with their labels before anything is
shuffled. From the root down, a host's tree of segments is generalised: a
segment with less than a share of its node's pages becomes a wildcard when the
node has many children, and labelled siblings whose shares of good labels don't
differ significantly (two proportions, z) are merged into one branch. After
wildcards a node has at most 1 / share + few children, so a node's list is
bounded. A template's purity is its share of good labels, smoothed towards its
host's, which is smoothed towards the whole's; a template below the threshold
is rejected.

Nulls: a null url, or one without ://, has an empty host and path. A path's
segments beyond depth count as one. A null label is no label. A page without
any label in its host is judged by the whole's purity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import cut

Rule = tuple[str, str]


@dataclass(frozen=True)
class UrlTree:
    depth: int = 12
    share: float = 0.05
    few: int = 8
    least_labels: int = 10
    z: float = 1.96
    weight: float = 20.0
    purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    form = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    host = F.translate(F.regexp_extract(url, form, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def by_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        at, _, rest = r.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def typed(path: Column, depth: int) -> Column:
    seg = F.split(F.regexp_replace(path, "^/", ""), "/", depth)
    return F.array_join(F.transform(seg, lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9a-fA-F]{16,}", "#x"), "[0-9]+", "#")), "/")


#: Folds children sorted by their rate into branches: neighbours whose rates don't differ significantly are one.
_MERGE = """aggregate(
    array_sort(transform(kids, k -> struct((k.good + 1) / (k.labelled + 2) AS rate, k.seg AS seg, k.labelled AS labelled, k.good AS good))),
    cast(array() AS array<struct<segs: array<string>, labelled: bigint, good: bigint>>),
    (acc, x) -> CASE
        WHEN size(acc) > 0 AND x.labelled >= {least} AND element_at(acc, -1).labelled >= {least}
             AND abs(x.good / x.labelled - element_at(acc, -1).good / element_at(acc, -1).labelled)
                 <= {z} * sqrt(greatest(1e-9, ((x.good + element_at(acc, -1).good) / (x.labelled + element_at(acc, -1).labelled))
                    * (1 - (x.good + element_at(acc, -1).good) / (x.labelled + element_at(acc, -1).labelled))
                    * (1 / x.labelled + 1 / element_at(acc, -1).labelled)))
        THEN concat(slice(acc, 1, size(acc) - 1), array(struct(array_append(element_at(acc, -1).segs, x.seg) AS segs,
                    element_at(acc, -1).labelled + x.labelled AS labelled, element_at(acc, -1).good + x.good AS good)))
        ELSE concat(acc, array(struct(array(x.seg) AS segs, x.labelled AS labelled, x.good AS good)))
    END)"""


def templates(urls: DataFrame, p: UrlTree = UrlTree()) -> DataFrame:
    """Of rows host, typed, label (1 good, 0 bad, null none): rows host, typed, template, purity, rejected."""
    rows = urls.groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("good"))
    rows = cut(rows.withColumn("prefix", F.lit("")).withColumn("segs", F.split("typed", "/")))
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(deepest):
        here = rows.filter(F.size("segs") > d).withColumn("seg", F.col("segs")[d])
        kids = here.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        node = kids.groupBy("host", "prefix").agg(F.sum("n").alias("all"), F.count("*").alias("many"))
        literal = (F.col("many") <= p.few) | (F.col("n") >= F.col("all") * p.share)
        kids = cut(kids.join(node, ["host", "prefix"]).select("host", "prefix", "seg", F.when(literal, F.col("seg")).otherwise(F.lit("*")).alias("name"), "labelled", "good"))
        named = kids.groupBy("host", "prefix", "name").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        lists = named.groupBy("host", "prefix").agg(F.collect_list(F.struct(F.col("name").alias("seg"), "labelled", "good")).alias("kids"))
        branches = lists.select("host", "prefix", F.explode(F.expr(_MERGE.format(least=p.least_labels, z=p.z))).alias("b"))
        label = F.when(F.size("b.segs") > 1, F.concat(F.lit("{"), F.array_join(F.array_sort("b.segs"), "|"), F.lit("}"))).otherwise(F.col("b.segs")[0])
        branches = branches.select("host", "prefix", F.explode("b.segs").alias("name"), label.alias("branch"))
        step = cut(kids.join(branches, ["host", "prefix", "name"]).select("host", "prefix", "seg", "branch"))
        moved = rows.withColumn("seg", F.when(F.size("segs") > d, F.col("segs")[d])).join(step, ["host", "prefix", "seg"], "left")
        rows = cut(moved.withColumn("prefix", F.when(F.col("branch").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "branch"))).drop("seg", "branch"))
    total = rows.agg(F.sum("good").alias("g"), F.sum("labelled").alias("n")).first()
    base = ((total["g"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = rows.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hn")).select("host", ((F.col("hg") + p.weight * base) / (F.col("hn") + p.weight)).alias("hp"))
    leaves = rows.groupBy("host", "prefix").agg(F.sum("good").alias("tg"), F.sum("labelled").alias("tn")).join(hosts, "host")
    leaves = leaves.select("host", "prefix", ((F.col("tg") + p.weight * F.col("hp")) / (F.col("tn") + p.weight)).alias("purity"))
    return cut(rows.join(leaves, ["host", "prefix"]).select("host", "typed", F.col("prefix").alias("template"), "purity", (F.col("purity") < p.purity).alias("rejected")))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], p: UrlTree = UrlTree()) -> DataFrame:
    """Of pages (page_id, url) and labels (page_id, label): page_id, host, path, rule, verdict, template, purity. Of several labels of a page the least counts."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("typed", typed(F.col("path"), p.depth))
    known = labels.filter("page_id IS NOT NULL AND label IS NOT NULL").groupBy("page_id").agg(F.min("label").alias("label"))
    tree = templates(urls.join(known, "page_id", "left").select("host", "typed", "label"), p)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    out = urls.join(tree, ["host", "typed"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
