"""Queries clu_*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.base import r6
from ..operators import cluster as C
from .registry import query

PCS = ["PC1", "PC2"]


def _z(spark, d):
    return C.standardise(X.scores(spark, d, 2), PCS)


@query("clu_01", """WITH @scores, m AS (SELECT avg("PC1") AS a, stddev_samp("PC1") AS b, avg("PC2") AS c, stddev_samp("PC2") AS e FROM scores)
SELECT "ID", R6(("PC1"-a)/b) AS "PC1", R6(("PC2"-c)/e) AS "PC2" FROM scores, m""")
def standardised(spark, d):
    return _z(spark, d).select("ID", *[r6(F.col(c)).alias(c) for c in PCS])


@query("clu_02")
def kmeans(spark, d):
    return C.kmeans(_z(spark, d), PCS, 3, nstart=20, id_col="ID").select("ID", "cluster")


@query("clu_05")
def wcss(spark, d):
    c = C.wcss_curve(_z(spark, d), PCS, 10, nstart=25)
    return c.select("k", r6(F.col("wcss")).alias("wcss"))


_CURVE = """curve AS (SELECT l_linenumber AS k, sum(l_quantity)/l_linenumber AS wcss FROM lineitem GROUP BY l_linenumber)"""


@query("clu_06", f"""WITH {_CURVE}, r AS (SELECT min(k) AS k0, max(k) AS k1, min(wcss) AS w0, max(wcss) AS w1, arg_min(wcss, k) AS a, arg_max(wcss, k) AS z FROM curve),
p AS (SELECT k, (k-k0)/(k1-k0) AS x, (wcss-w0)/(w1-w0) AS y, (a-w0)/(w1-w0) AS y0, (z-w0)/(w1-w0) AS y1 FROM curve, r)
SELECT arg_max(k, abs((y1-y0)*x - y + y0)/sqrt((y1-y0)**2 + 1)) AS k FROM p""")
def elbow(spark, d):
    curve = X.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("q"))
    return C.elbow(curve.select("k", (F.col("q") / F.col("k")).alias("wcss")))


@query("clu_07", """WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum((a.x-b.x)**2 + (a.y-b.y)**2) AS t, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
w AS (SELECT vec_id, label, max(t/(n-1)) FILTER (label = other AND n > 1) AS a, min(t/n) FILTER (label <> other) AS b FROM s GROUP BY 1, 2)
SELECT vec_id AS "ID", label AS cluster, R6(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a, b) END) AS width FROM w""")
def silhouette(spark, d):
    s = C.silhouette(X.scores(spark, d, 2), PCS, "group", "ID")
    return s.select("ID", "cluster", r6(F.col("width")).alias("width"))


@query("clu_08")
def gap(spark, d):
    g = C.gap_statistic(_z(spark, d), PCS, "ID")
    return g.select("k", *[r6(F.col(c)).alias(c) for c in ("log_w", "expected", "gap", "se")])


_Z = """z AS (SELECT "ID", ("PC1" - avg("PC1") OVER ())/stddev_samp("PC1") OVER () AS x, ("PC2" - avg("PC2") OVER ())/stddev_samp("PC2") OVER () AS y, "group" AS g FROM scores)"""


@query("clu_05_given", f"""WITH @scores, {_Z}, c AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM z GROUP BY g)
SELECT R6(sum((x - mx)**2 + (y - my)**2)/2) AS w, count(*) AS n FROM z JOIN c USING (g)""")
def dispersion_of_groups(spark, d):
    z = _z(spark, d)
    return z.agg(F.count("*").alias("n")).withColumn("w", r6(F.lit(C.dispersion(z, PCS, "group"))))


# at one cluster a reference set is only its box: standardised columns have the axes (1, 1) and (1, -1), the first by their correlation
@query("clu_08_one", f"""WITH @scores, {_Z}, r AS (SELECT CASE WHEN corr(x, y) >= 0 THEN 1 ELSE -1 END AS s FROM z),
p AS (SELECT max((x + s*y)/sqrt(2)) - min((x + s*y)/sqrt(2)) AS w0, max((x - s*y)/sqrt(2)) - min((x - s*y)/sqrt(2)) AS w1, sum(x*x + y*y)/2 AS own FROM z, r),
u AS (SELECT b, j, var_pop(('0x' || left(md5('1:' || b || ':' || j || ':' || "ID"), 8))::BIGINT/4294967296.0::DOUBLE)*count(*) AS v
  FROM z, range(1, 51) t(b), range(0, 2) q(j) GROUP BY b, j),
l AS (SELECT b, ln(sum(v*CASE WHEN j = 0 THEN w0*w0 ELSE w1*w1 END)/2) AS w FROM u, p GROUP BY b)
SELECT 1 AS k, R6(any_value(ln(own))) AS log_w, R6(avg(w)) AS expected, R6(avg(w) - any_value(ln(own))) AS gap,
  R6(sqrt(1 + 1/50.0)*stddev_samp(w)) AS se FROM l, p""")
def gap_of_one(spark, d):
    g = C.gap_statistic(_z(spark, d), PCS, "ID", max_k=1)
    return g.select("k", *[r6(F.col(c)).alias(c) for c in ("log_w", "expected", "gap", "se")])


_WIDTHS = """wd AS (SELECT l_linenumber AS k, avg(l_discount) AS s FROM lineitem GROUP BY l_linenumber)"""
_GAPS = """gp AS (SELECT l_linenumber AS k, avg(l_tax)*l_linenumber AS gap, stddev_samp(l_tax) AS se, lead(avg(l_tax)*l_linenumber) OVER (ORDER BY l_linenumber) AS nx FROM lineitem GROUP BY l_linenumber),
tp AS (SELECT arg_min(k, k) AS k, arg_min(gap, k) AS gap, arg_min(se, k) AS se FROM gp WHERE nx IS NULL OR nx < gap)"""


@query("clu_09", f"""WITH {_CURVE}, r AS (SELECT min(k) AS k0, max(k) AS k1, min(wcss) AS w0, max(wcss) AS w1, arg_min(wcss, k) AS a, arg_max(wcss, k) AS z FROM curve),
p AS (SELECT k, (k-k0)/(k1-k0) AS x, (wcss-w0)/(w1-w0) AS y, (a-w0)/(w1-w0) AS y0, (z-w0)/(w1-w0) AS y1 FROM curve, r), {_WIDTHS}, {_GAPS}
SELECT 'elbow' AS method, arg_max(k, abs((y1-y0)*x - y + y0)/sqrt((y1-y0)**2 + 1)) AS k FROM p UNION ALL
SELECT 'silhouette', arg_max(k, s) FROM wd WHERE k > 1 UNION ALL SELECT 'gap', min(gp.k) FROM gp, tp WHERE gp.k <= tp.k AND gp.gap >= tp.gap - tp.se""")
def chosen_k(spark, d):
    t = X.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(
        F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("silhouette"), F.avg("l_tax").alias("t"), F.stddev_samp("l_tax").alias("se"))
    return C.choose_k(t.select("k", (F.col("q") / F.col("k")).alias("wcss")), t.select("k", "silhouette"),
                      t.select("k", (F.col("t") * F.col("k")).alias("gap"), "se"))


@query("clu_09_rows")
def chosen_k_of_rows(spark, d):
    return C.optimal_k(_z(spark, d), PCS, "ID")
