"""Queries over frames of attacked jobs: what predicts harm, by fits, held-out errors and rank correlations.

A job is a cell (alpha = order status, seed = region, algorithm = side of the
customer's balance, pair = market segment, q = poison dose by order priority);
its clients are the region's nations, its harm the mean price.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import formulas, inference
from larkspur.operators.curation import cut
from larkspur.operators.formulas import factor
from larkspur.plans.registry import query, rounded, table


def jobs(spark, d) -> DataFrame:
    c, n, o = (table(spark, d, x) for x in ("customer", "nation", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    q = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "2-HIGH", 0.5).otherwise(0.25)
    cell = ["alpha", "seed", "algorithm", "pair", "q"]
    side = F.when(F.col("c_acctbal") < 4500, "fedavg").otherwise("fedprox")
    client = j.select(F.col("o_orderstatus").alias("alpha"), F.col("n_regionkey").alias("seed"), side.alias("algorithm"), F.col("c_mktsegment").alias("pair"), q.alias("q"), "n_nationkey", "o_totalprice")
    client = client.groupBy(*cell, "n_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))
    # entropy of shares n / N by sums alone: ln N - sum(n ln n) / N
    out = client.groupBy(*cell).agg(F.sum("n").alias("n_c"), F.max("n").alias("attacker_n"), F.sum(F.col("n") * F.log("n")).alias("_nln"), (F.sum("price") / F.sum("n") / 100000).alias("harm"))
    out = out.withColumn("mc", F.col("attacker_n") / F.col("n_c")).withColumn("entropy", (F.log("n_c") - F.col("_nln") / F.col("n_c")) / F.log(F.lit(5.0)))
    flips = F.when(F.col("q") == 1, S.expected_flips(F.col("attacker_n"), 1.0)).when(F.col("q") == 0.5, S.expected_flips(F.col("attacker_n"), 0.5)).otherwise(S.expected_flips(F.col("attacker_n"), 0.25))
    out = out.withColumn("qmc", F.col("q") * F.col("mc")).withColumn("realized", flips / F.col("n_c"))
    return out.drop("_nln")


JOBS = """cl AS (SELECT o_orderstatus AS alpha, n_regionkey AS seed, CASE WHEN c_acctbal < 4500 THEN 'fedavg' ELSE 'fedprox' END AS algorithm, c_mktsegment AS pair, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.5 ELSE 0.25 END::DOUBLE AS q, n_nationkey, count(*) AS n, sum(o_totalprice) AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5, 6),
jc AS (SELECT alpha, seed, algorithm, pair, q, sum(n)::BIGINT AS n_c, max(n) AS attacker_n, max(n) / sum(n)::DOUBLE AS mc, -sum(n / nn * ln(n / nn)) / ln(5) AS entropy, sum(price) / sum(n) / 100000 AS harm FROM (SELECT *, sum(n) OVER (PARTITION BY alpha, seed, algorithm, pair, q)::DOUBLE AS nn FROM cl) GROUP BY 1, 2, 3, 4, 5),
jo AS (SELECT *, q * mc AS qmc, CASE WHEN q >= 1 THEN attacker_n ELSE least(attacker_n, greatest(1, floor(attacker_n * q)))::BIGINT END / n_c::DOUBLE AS realized FROM jc),
fr AS (SELECT 'dose' AS frame, * FROM jo UNION ALL SELECT 'flip1', * FROM jo WHERE q = 1)"""

ALPHA, ALGORITHM, PAIR = factor("alpha"), factor("algorithm"), factor("pair")
#: The fits of each frame, and those whose held-out errors are taken.
FITS = {
    "flip1": {"alpha": [ALPHA], "alpha+mc": [ALPHA, "mc"], "alpha+entropy": [ALPHA, "entropy"], "all+mc": [ALPHA, PAIR, ALGORITHM, "mc"]},
    "dose": {"alpha": [ALPHA], "alpha+mc": [ALPHA, "mc"], "alpha+q": [ALPHA, "q"], "alpha+qmc": [ALPHA, "qmc"], "alpha+qmc+mc": [ALPHA, "qmc", "mc"]},
}
HELD = {"flip1": ["alpha", "alpha+mc", "alpha+entropy"], "dose": list(FITS["dose"])}


def frames(spark, d) -> dict[str, DataFrame]:
    j = cut(jobs(spark, d))
    return {"flip1": j.filter("q = 1"), "dose": j}


def terms_sql() -> str:
    """(frame, model, p, name, pos): a model's columns in order, then the harm."""
    levels = {ALPHA: ["O", "P"], ALGORITHM: ["fedprox"], PAIR: ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
    rows = []
    for frame, models in FITS.items():
        for model, terms in models.items():
            names = ["intercept", *(n for t in terms for n in ([f"{t.column}[{v}]" for v in levels[t]] if isinstance(t, factor) else [t])), "harm"]
            rows += [f"('{frame}', '{model}', {len(names) - 1}, '{n}', {i})" for i, n in enumerate(names, 1)]
    return "mo AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(frame, model, p, name, pos))"


#: Normal equations, solved by sweeping one pivot a step; unit is the seed that is left out, or none.
SWEEP = f"""WITH RECURSIVE {JOBS}, {terms_sql()},
lo AS (SELECT frame, seed, row_number() OVER () AS rid, unnest(['intercept', 'alpha[O]', 'alpha[P]', 'algorithm[fedprox]', 'pair[BUILDING]', 'pair[FURNITURE]', 'pair[HOUSEHOLD]', 'pair[MACHINERY]', 'mc', 'entropy', 'q', 'qmc', 'harm']) AS name,
  unnest([1, (alpha = 'O')::INT, (alpha = 'P')::INT, (algorithm = 'fedprox')::INT, (pair = 'BUILDING')::INT, (pair = 'FURNITURE')::INT, (pair = 'HOUSEHOLD')::INT, (pair = 'MACHINERY')::INT, mc, entropy, q, qmc, harm]::DOUBLE[]) AS v FROM fr),
ms AS (SELECT a.frame, a.seed, a.name AS x, b.name AS y, sum(a.v * b.v) AS v FROM lo a JOIN lo b ON a.rid = b.rid GROUP BY ALL),
mt AS (SELECT a.frame, a.model, a.p, seed, a.pos AS i, b.pos AS j, v FROM ms JOIN mo a ON a.frame = ms.frame AND a.name = ms.x JOIN mo b ON b.frame = a.frame AND b.model = a.model AND b.name = ms.y),
ba AS (SELECT frame, model, p, -1 AS unit, i, j, sum(v) AS v FROM mt GROUP BY ALL UNION ALL SELECT m.frame, m.model, m.p, u.seed, m.i, m.j, sum(m.v) FROM mt m JOIN (SELECT DISTINCT seed FROM mt) u ON u.seed <> m.seed GROUP BY ALL),
sw AS (SELECT frame, model, p, unit, i, j, v, 0 AS k FROM ba UNION ALL SELECT frame, model, p, unit, i, j, CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / d WHEN i = k + 1 THEN v / d WHEN j = k + 1 THEN -v / d ELSE v - c * r / d END, k + 1 FROM
  (SELECT *, max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY frame, model, unit) AS d, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY frame, model, unit, j) AS r, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY frame, model, unit, i) AS c FROM sw WHERE k < p)),
so AS (SELECT * FROM sw WHERE k = p)"""


@query(SWEEP + """, nn AS (SELECT frame, model, sum(v) AS n FROM mt WHERE i = 1 AND j = 1 GROUP BY ALL), yy AS (SELECT frame, model, p, sum(v) FILTER (i = p + 1 AND j = p + 1) AS yy, sum(v) FILTER (i = 1 AND j = p + 1) AS sy FROM mt GROUP BY ALL),
ss AS (SELECT so.frame, so.model, so.p, so.v AS sse, n, yy - sy * sy / n AS sst FROM so JOIN nn USING (frame, model) JOIN yy USING (frame, model) WHERE unit = -1 AND i = so.p + 1 AND j = so.p + 1)
SELECT b.frame, b.model, mo.name AS term, ss.n::BIGINT AS n, round(b.v, 6) + 0 AS estimate, round(sqrt(g.v * sse / (n - ss.p)), 6) AS se, round(1 - sse / sst, 6) AS r2, round(1 - (sse / (n - ss.p)) / (sst / (n - 1)), 6) AS r2_adj
FROM so b JOIN so g ON g.frame = b.frame AND g.model = b.model AND g.unit = -1 AND g.i = b.i AND g.j = b.i JOIN ss ON ss.frame = b.frame AND ss.model = b.model JOIN mo ON mo.frame = b.frame AND mo.model = b.model AND mo.pos = b.i WHERE b.unit = -1 AND b.j = b.p + 1 AND b.i <= b.p""")
def harm_fits(spark, d):
    """The nine fits of harm on the setting, the monopoly, the entropy and the dose."""
    rows = []
    for name, df in frames(spark, d).items():
        m = formulas.moments(df, list(FITS[name].values()), "harm", "seed")
        for model, terms in FITS[name].items():
            f = formulas.ols(m, terms)
            rows += [(name, model, c["term"], f["n"], c["estimate"], c["se"], f["r2"], f["r2_adj"]) for c in f["coefficients"]]
    return rounded(spark.createDataFrame(rows, "frame string, model string, term string, n long, estimate double, se double, r2 double, r2_adj double"))


HELD_SQL = ", ".join(f"('{f}', '{m}')" for f, ms in HELD.items() for m in ms)


@query(SWEEP + f""", b AS (SELECT frame, model, p, unit, i, v FROM so WHERE unit >= 0 AND j = p + 1 AND i <= p UNION ALL SELECT DISTINCT frame, model, p, unit, p + 1, -1.0 FROM so WHERE unit >= 0),
sq AS (SELECT mt.frame, mt.model, mt.seed, sum(x.v * y.v * mt.v) AS sse FROM mt JOIN b x ON x.frame = mt.frame AND x.model = mt.model AND x.unit = mt.seed AND x.i = mt.i JOIN b y ON y.frame = mt.frame AND y.model = mt.model AND y.unit = mt.seed AND y.i = mt.j GROUP BY ALL),
ns AS (SELECT frame, model, seed, v AS n FROM mt WHERE i = 1 AND j = 1)
SELECT frame, model, sum(n)::BIGINT AS n, round(sqrt(avg(sse / n)), 6) AS rmse FROM sq JOIN ns USING (frame, model, seed) WHERE (frame, model) IN ({HELD_SQL}) GROUP BY ALL""")
def harm_held_out(spark, d):
    """The eight held-out errors: each seed's jobs under the fit of the others."""
    rows = []
    for name, df in frames(spark, d).items():
        m = formulas.moments(df, list(FITS[name].values()), "harm", "seed")
        for model in HELD[name]:
            e = formulas.leave_one_out(m, FITS[name][model])
            rows.append((name, model, e["n"], e["rmse"]))
    return rounded(spark.createDataFrame(rows, "frame string, model string, n long, rmse double"))


def ranked_sql(select: str, by: str, x: str, y: str) -> str:
    """Rank correlation of x and y in fr within the partition by, and the columns that select adds."""
    rank = lambda v: f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE"
    return f"SELECT {select}, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM (SELECT *, {rank(x)} AS rx, {rank(y)} AS ry FROM fr) GROUP BY ALL"


CORRELATIONS = [("flip1", "mc"), ("dose", "qmc"), ("dose", "mc"), ("dose", "realized")]


@query(f"WITH {JOBS} " + " UNION ALL ".join(
    [ranked_sql(f"'{f}' AS frame, '{x}' AS predictor, 'all' AS alpha", "frame", x, "harm").replace("FROM fr)", f"FROM fr WHERE frame = '{f}')") for f, x in CORRELATIONS]
    + [ranked_sql(f"'{f}' AS frame, '{x}' AS predictor, alpha", "frame, alpha", x, "harm").replace("FROM fr)", f"FROM fr WHERE frame = '{f}')") for f, x in CORRELATIONS]
    + [ranked_sql("'flip1' AS frame, 'mc, fedavg' AS predictor, 'all' AS alpha", "frame", "mc", "harm").replace("FROM fr)", "FROM fr WHERE frame = 'flip1' AND algorithm = 'fedavg')")]
    + [ranked_sql("'flip1' AS frame, 'mc, fedavg' AS predictor, alpha", "frame, alpha", "mc", "harm").replace("FROM fr)", "FROM fr WHERE frame = 'flip1' AND algorithm = 'fedavg')")]
))
def harm_correlations(spark, d):
    """Rank correlations with harm over each frame and within each alpha."""
    f = frames(spark, d)
    sides = [(name, x, x, f[name]) for name, x in CORRELATIONS] + [("flip1", "mc", "mc, fedavg", f["flip1"].filter("algorithm = 'fedavg'"))]
    each = [df.select(F.lit(name).alias("frame"), F.lit(said).alias("predictor"), F.explode(F.array(F.lit("all"), F.col("alpha"))).alias("alpha"), F.col(x).alias("x"), "harm") for name, x, said, df in sides]
    return rounded(inference.spearman(reduce(DataFrame.unionByName, each), ["frame", "predictor", "alpha"], "x", "harm"))


@query(f"WITH {JOBS} SELECT 'flip1' AS frame, count(*) AS n, round(max(abs(mc - realized)), 9) + 0 AS most FROM fr WHERE frame = 'flip1' UNION ALL SELECT 'dose below 1', count(*), round(max(abs(realized - qmc)), 9) + 0 FROM fr WHERE frame = 'dose' AND q < 1")
def realized_doses(spark, d):
    """How far the realized dose is from the intended one: none at dose 1, by whole samples below."""
    f = frames(spark, d)
    most = lambda df, name, a, b: df.agg(F.lit(name).alias("frame"), F.count("*").alias("n"), F.max(F.abs(F.col(a) - F.col(b))).alias("most"))
    return rounded(most(f["flip1"], "flip1", "mc", "realized").unionByName(most(f["dose"].filter("q < 1"), "dose below 1", "realized", "qmc")), 9)
