"""Queries prj_*, agg_*, srt_*, set_* and part of win_* over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import draws
from ..functions import efa as E
from ..functions import outline as O
from ..functions.base import r6
from ..operators import density as D
from ..operators import ellipse as L
from ..operators import filters as W
from ..operators import hull as H
from ..operators import tables as T
from ..operators.joins import first_match
from ..sources.text import pc_columns
from .outline import long
from .registry import query

# ---- filters and validation ---------------------------------------------------


@query("prj_01", """SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 5 AND p_size < 40 AND p_brand <> 'Brand#2'
AND contains(p_name, 'i') AND p_type LIKE 'E%' AND p_name LIKE '%t' AND p_retailprice > 901 AND p_name IS NOT NULL""")
def filtered(spark, d):
    return W.apply_filters(X.table(spark, d, "part"), [
        ("p_size", "ge", 5), ("p_size", "lt", "40"), ("p_brand", "ne", "Brand#2"), ("p_name", "contains", "i"),
        ("p_type", "starts", "E"), ("p_name", "ends", "t"), ("p_retailprice", "gt", 901), ("p_name", "not_na")]).select(
        "p_partkey", "p_name", "p_size")


@query("prj_02", """WITH @dirty SELECT "ID", R6(x) AS x, R6(y) AS y, g FROM dirty WHERE x IS NOT NULL AND isfinite(x) AND isfinite(y) AND g IS NOT NULL""")
def finite(spark, d):
    f = W.require_rows(W.finite_rows(X.dirty(spark, d), "x", "y", "g"), 3)
    return f.select("ID", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "g")


@query("prj_03", """WITH @dirty SELECT "ID", g FROM dirty WHERE x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND g IN (1, 3, 5)""")
def complete(spark, d):
    return W.complete_cases(X.dirty(spark, d), ["x", "y", "g"], "g", [1, 3, 5]).select("ID", "g")


@query("prj_04", 'WITH @scores SELECT "ID", "group" FROM scores WHERE "group" IN (0, 2, 4)')
def kept_groups(spark, d):
    return W.require_rows(W.keep_groups(X.scores(spark, d), "group", [0, 2, 4]), 3).select("ID", "group")


@query("prj_05", 'WITH @scores SELECT "ID", R6("PC1") AS "PC1", R6("PC2") AS "PC2", R6("PC3") AS "PC3" FROM scores')
def capped_pcs(spark, d):
    s = W.select_pcs(X.scores(spark, d), 3, keep=["ID"])
    return s.select("ID", *[r6(F.col(c)).alias(c) for c in pc_columns(s.columns)])


@query("prj_06", """SELECT l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS "group", count(*) AS n FROM lineitem GROUP BY 1""")
def composed_group(spark, d):
    t = W.compose_group(X.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return t.groupBy("group").agg(F.count("*").alias("n"))


def _damaged(spark, d):
    """Every 7th outline misses a coordinate, every 11th has two points, every 13th an infinity."""
    hole = F.transform(F.col("coo"), lambda p, i: F.struct(
        F.when((F.col("id") % 7 == 0) & (i == 5), F.lit(None).cast("double"))
        .when((F.col("id") % 13 == 0) & (i == 9), F.lit(float("inf"))).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    return X.landmarks(X.outlines(spark, d)).withColumn("coo", hole).withColumn(
        "coo", F.when(F.col("id") % 11 == 0, F.slice("coo", 1, 2)).otherwise(F.col("coo")))


@query("prj_07", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0")
def bad_shapes(spark, d):
    return W.shape_problems(_damaged(spark, d))


@query("prj_08", "SELECT vec_id AS id, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS valid FROM embeddings")
def valid_imports(spark, d):
    return _damaged(spark, d).select("id", O.is_valid_import(F.col("coo")).alias("valid"))


@query("prj_09", """SELECT count(*) AS n_shapes, count(*) AS n_coo, true AS same_landmark_count, false AS landmarks_in_range,
count(*) FILTER (vec_id % 7 = 0 AND vec_id % 11 <> 0) AS bad_shapes FROM embeddings""")
def integrity(spark, d):
    return W.integrity_report(_damaged(spark, d))


# ---- flattening and layouts ------------------------------------------------------


@query("prj_10", 'WITH @scores SELECT "ID", "group", ' + ", ".join(f'R6("PC{i}") AS "PC{i}"' for i in range(1, 6)) + " FROM scores")
def flattened(spark, d):
    shares = [0.3, 0.25, 0.2, 0.1, 0.05, 0.04, 0.03, 0.03]
    s = T.flatten_scores(X.scores(spark, d), retain=0.9, shares=shares)
    return s.select("ID", "group", *[r6(F.col(c)).alias(c) for c in pc_columns(s.columns)])


@query("prj_11", """SELECT vec_id AS id, label AS actual, CASE WHEN e1 >= e2 AND e1 >= e3 THEN 0 WHEN e2 >= e3 THEN 1 ELSE 2 END AS predicted,
R6(greatest(e1, e2, e3)/(e1 + e2 + e3)) AS posterior, R6(p1) AS "PC1", R6(p2) AS "PC2" FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS p1,
embedding[2]::DOUBLE AS p2, exp(embedding[1]::DOUBLE) AS e1, exp(embedding[2]::DOUBLE) AS e2, exp(embedding[3]::DOUBLE) AS e3 FROM embeddings)""")
def flattened_classes(spark, d):
    s = X.scores(spark, d)
    e = [F.exp(F.col(f"PC{i}")) for i in (1, 2, 3)]
    pred = s.select(F.col("ID").alias("id"), F.col("group").alias("actual"), "PC1", "PC2", "PC3",
                    F.array(*[v / (e[0] + e[1] + e[2]) for v in e]).alias("posterior")).withColumn(
        "predicted", (O.which_max(F.col("posterior")) - 1))
    f = T.flatten_classes(pred, ["PC1", "PC2", "PC3"], retain=2)
    return f.select("id", "actual", "predicted", *[r6(F.col(c)).alias(c) for c in ("posterior", "PC1", "PC2")])


@query("prj_12", "WITH @pts SELECT id, label, seq, R6(x) AS x, R6(y) AS y FROM pts")
def built_shapes(spark, d):
    p = X.points(spark, d)
    fac = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return long(T.build_outlines(p.select("id", "seq", "x", "y"), fac), F.col("coo"), "id", "label")


@query("prj_13", "WITH @coe SELECT id, 'efourier' AS method, true AS norm, 48::INT AS n_coef, R6(sum(value)) AS total FROM coe GROUP BY id")
def coefficient_table(spark, d):
    c = T.coefficient_table(E.efourier(X.outlines(spark, d), 12), "coe", "efourier", True)
    meta = c.schema["coe"].metadata
    return c.select("id", F.lit(meta["method"]).alias("method"), F.lit(meta["norm"]).alias("norm"), F.size("coe").alias("n_coef"),
                    r6(F.aggregate("coe", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("prj_14", """WITH @pts SELECT id, CASE WHEN seq <= 16 THEN 1 WHEN seq <= 40 THEN 2 ELSE 3 END::INT AS piece,
(seq - CASE WHEN seq <= 16 THEN 0 WHEN seq <= 40 THEN 16 ELSE 40 END)::INT AS seq, R6(x) AS x, R6(y) AS y FROM pts""")
def layouts(spark, d):
    # outline -> wide -> outline -> points -> outline -> pieces
    o = X.outlines(spark, d)
    back = T.from_wide(T.to_wide(o, 64), 64)
    again = T.build_outlines(X.to_points(back))
    p = again.select("id", F.posexplode(T.split_lengths(F.col("coo"), [16, 24, 24])).alias("i", "piece_coo")).select(
        "id", (F.col("i") + 1).cast("int").alias("piece"), "piece_coo")
    return long(p, F.col("piece_coo"), "id", "piece")


@query("prj_14_long", """WITH @long SELECT id AS "ID", 'PC' || pc AS variable, R6(score) AS value FROM long""")
def melted(spark, d):
    s = X.scores(spark, d)
    return T.long_matrix(s, "ID", pc_columns(s.columns)).select("ID", "variable", r6(F.col("value")).alias("value"))


@query("prj_15", "WITH @coe SELECT id, letter, (h - 1)::INT AS h, R6(value) AS value FROM coe WHERE h BETWEEN 2 AND 8")
def selected_coefficients(spark, d):
    c = E.efourier(X.outlines(spark, d), 12).select("id", E.select_harmonics(F.col("coe"), 8, 1, 12).alias("coe"))
    return E.long_coefficients(c).select("id", "letter", "h", r6(F.col("value")).alias("value"))


@query("prj_16", """WITH @coe SELECT id, h, R6(max(value) FILTER (letter = 'A')) AS an, R6(max(value) FILTER (letter = 'B')) AS bn,
R6(max(value) FILTER (letter = 'C')) AS cn, R6(max(value) FILTER (letter = 'D')) AS dn FROM coe GROUP BY id, h""")
def split_coefficients(spark, d):
    c = E.efourier(X.outlines(spark, d), 12).select("id", E.split_blocks(F.col("coe"), 12).alias("b"))
    z = F.arrays_zip("b.an", "b.bn", "b.cn", "b.dn")
    return c.select("id", F.posexplode(z).alias("p", "z")).select(
        "id", (F.col("p") + 1).cast("int").alias("h"), *[r6(F.col(f"z.{n}")).alias(n) for n in ("an", "bn", "cn", "dn")])


_W = [f"{letter}{h}" for h in range(1, 4) for letter in "ABCD"]


@query("prj_17", "WITH @coe SELECT id, " + ", ".join(
    f"R6(max(value) FILTER (letter = '{n[0]}' AND h = {n[1:]})) AS \"{n}\"" for n in _W) + " FROM coe GROUP BY id")
def rearranged(spark, d):
    w = T.wide_coefficients(E.efourier(X.outlines(spark, d), 3), 3, by="rank")
    return w.select("id", *[r6(F.col(n)).alias(n) for n in w.columns if n != "id"])


@query("prj_18", """WITH @ctr, m AS (SELECT id, max(greatest(abs(x), abs(y))) AS m FROM ctr GROUP BY id),
k AS (SELECT id, id || ' (' || row_number() OVER (ORDER BY id) || ')' AS label FROM m WHERE id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0)
SELECT id, k.label, seq, R6(x/m) AS x, R6(y/m) AS y FROM ctr JOIN m USING (id) JOIN k USING (id)""")
def panel(spark, d):
    return long(T.panel(_damaged(spark, d)), F.col("coo"), "id", "label")


@query("prj_19", """WITH @scores SELECT 'PC1-PC2' AS pair, "ID", R6("PC1") AS x, R6("PC2") AS y FROM scores
UNION ALL SELECT 'PC3-PC4', "ID", R6("PC3"), R6("PC4") FROM scores""")
def consecutive_columns(spark, d):
    return T.column_pairs(X.scores(spark, d), ["PC1", "PC2", "PC3", "PC4"], ["ID"]).select(
        "pair", "ID", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("prj_20", """SELECT c_custkey, CASE WHEN c_custkey IN (7, 12, 30) THEN 'picked' WHEN c_custkey BETWEEN 20 AND 120 THEN 'late'
WHEN c_custkey BETWEEN 5 AND 100 THEN 'early' ELSE 'none' END AS "group", CASE WHEN f BETWEEN 3 AND 9 THEN 'seen' ELSE 'none' END AS nation_group
FROM customer JOIN (SELECT c_nationkey, min(c_custkey) AS p FROM customer GROUP BY 1) USING (c_nationkey)
JOIN (SELECT p, row_number() OVER (ORDER BY p) AS f FROM (SELECT DISTINCT min(c_custkey) AS p FROM customer GROUP BY c_nationkey)) USING (p)""")
def labelled(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    r = W.label_by_range(c, "c_custkey", [("early", 100, 5), ("late", 20, 120), ("lost", 1, -5)], "g", "none")
    r = r.withColumn("group", F.coalesce(F.expr("case when c_custkey in (7, 12, 30) then 'picked' end"), "g"))
    picked = W.label_by_list(r, "c_custkey", [("picked", [7, 12, 30])], "p", None)
    seen = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("p")).orderBy("p").limit(9).collect()
    out = W.label_by_range(picked, "c_nationkey", [("seen", seen[8].c_nationkey, seen[2].c_nationkey)], "nation_group",
                           "none", sort_ids=False, order="c_custkey")
    return out.select("c_custkey", F.coalesce("p", "group").alias("group"), "nation_group")


# gift wrapping per group: the next vertex leaves everything else on its left
_WRAP = """RECURSIVE src AS (SELECT DISTINCT {g} AS g, x, y FROM {src}),
st AS (SELECT g, arg_min(x, (x, y)) AS x, arg_min(y, (x, y)) AS y FROM src GROUP BY g),
hull(g, k, x, y, a) AS (SELECT g, 1, x, y, -pi()/2 FROM st UNION ALL
SELECT h.g, h.k + 1, n.px, n.py, n.ang FROM hull h, LATERAL (SELECT px, py, ang FROM (
 SELECT s.x AS px, s.y AS py, atan2((s.y - h.y)/sy, (s.x - h.x)/sx) + CASE WHEN atan2((s.y - h.y)/sy, (s.x - h.x)/sx) < h.a - 1e-9 THEN 2*pi() ELSE 0 END AS ang,
 ((s.x - h.x)/sx)**2 + ((s.y - h.y)/sy)**2 AS dd FROM src s, spr WHERE spr.g = h.g AND s.g = h.g AND (s.x <> h.x OR s.y <> h.y))
 ORDER BY round(ang, 11), dd DESC LIMIT 1) n, st WHERE st.g = h.g AND (n.px <> st.x OR n.py <> st.y) AND h.k < 500),
spr AS (SELECT g, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM src GROUP BY g)"""


def hull_sql(src, g):
    text = _WRAP.format(src=src, g=g)
    # the spread is needed before the recursion
    head, spr = text[:text.index("hull(g")], text[text.index("spr AS"):]
    return head + spr + ", " + text[text.index("hull(g"):text.index(",\nspr AS")]


@query("prj_21", f"""WITH {hull_sql('(SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings WHERE label IN (1, 4, 7))', 'label')}
SELECT g AS "group", e.vec_id AS "ID" FROM hull h JOIN embeddings e ON e.label = h.g AND e.embedding[1]::DOUBLE = h.x AND e.embedding[2]::DOUBLE = h.y""")
def hull_layer(spark, d):
    s = W.keep_groups(X.scores(spark, d, 2), "group", [1, 4, 7])
    return H.convex_hull(s, ["group"], "PC1", "PC2", "ID").select("group", "ID")


# ---- aggregations -------------------------------------------------------------------


@query("agg_01", """WITH @scores SELECT "group", count(*) AS n, R6(avg("PC1")) AS mean_x, R6(stddev_samp("PC1")) AS sd_x, R6(min("PC1")) AS min_x,
R6(max("PC1")) AS max_x, R6(avg("PC2")) AS mean_y, R6(stddev_samp("PC2")) AS sd_y, R6(min("PC2")) AS min_y, R6(max("PC2")) AS max_y FROM scores GROUP BY "group\"""")
def summary(spark, d):
    t = T.group_summary(X.scores(spark, d), "group", "PC1", "PC2")
    return t.select("group", "n", *[r6(F.col(c)).alias(c) for c in t.columns if c not in ("group", "n")])


@query("agg_02", 'WITH @scores SELECT "group", R6(avg("PC1")) AS x, R6(avg("PC2")) AS y, count(*) AS n FROM scores WHERE "group" <> 0 GROUP BY "group"')
def centres(spark, d):
    t = T.cluster_centres(X.scores(spark, d), "group", "PC1", "PC2")
    return t.select("group", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "n")


@query("agg_06", """WITH @cloud, q AS (SELECT g, quantile_cont(y, 0.25) AS q1, median(y) AS m, quantile_cont(y, 0.75) AS q3 FROM cloud GROUP BY g)
SELECT g, R6(min(y) FILTER (y >= q1 - 1.5*(q3-q1))) AS lower, R6(max(q1)) AS q1, R6(max(m)) AS median, R6(max(q3)) AS q3,
R6(max(y) FILTER (y <= q3 + 1.5*(q3-q1))) AS upper, count(*) FILTER (y < q1 - 1.5*(q3-q1) OR y > q3 + 1.5*(q3-q1)) AS n_out FROM cloud JOIN q USING (g) GROUP BY g""")
def boxes(spark, d):
    t = T.box_statistics(X.cloud(spark, d), ["g"], "y")
    return t.select("g", *[r6(F.col(c)).alias(c) for c in ("lower", "q1", "median", "q3", "upper")], "n_out")


_CLOUD_HULL = hull_sql("(SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag FROM lineitem)", "l_returnflag")


@query("agg_07", f"""WITH {_CLOUD_HULL} SELECT g, CASE WHEN k = 1 THEN 1 ELSE max(k) OVER (PARTITION BY g) - k + 2 END::INT AS ord, R6(x) AS x, R6(y) AS y FROM hull""")
def hulls(spark, d):
    h = H.convex_hull(X.cloud(spark, d), ["g"], "x", "y", "id")
    return h.select("g", "ord", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("agg_08")
def onions(spark, d):
    o = H.onion(X.outlines(spark, d))
    return o.select("id", "layer", "ord", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("agg_09", f"""WITH {_CLOUD_HULL}, e AS (SELECT g, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
FROM hull WINDOW w AS (PARTITION BY g ORDER BY k)) SELECT g, round(abs(sum(x*ny - nx*y))/2/1000, 3) AS area FROM e GROUP BY g""")
def hull_areas(spark, d):
    return H.hull_area(X.cloud(spark, d), ["g"], "x", "y", "id").select("g", F.round(F.col("area") / 1000, 3).alias("area"))


# every plane through three points with all others on one side is a facet
@query("agg_10", """WITH s AS (SELECT label AS g, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
o AS (SELECT g, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM s GROUP BY g),
n AS (SELECT a.g, a.i AS i, b.i AS j, c.i AS k, a.x AS ax, a.y AS ay, a.z AS az, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx,
(b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz
FROM s a JOIN s b ON b.g = a.g AND b.i > a.i JOIN s c ON c.g = a.g AND c.i > b.i),
f AS (SELECT n.g, n.i, j, k, any_value(abs(nx*(ox-ax) + ny*(oy-ay) + nz*(oz-az))/6) AS v FROM n JOIN s ON s.g = n.g JOIN o ON o.g = n.g
WHERE s.i NOT IN (n.i, j, k) GROUP BY n.g, n.i, j, k HAVING min(nx*(x-ax) + ny*(y-ay) + nz*(z-az)) > 0 OR max(nx*(x-ax) + ny*(y-ay) + nz*(z-az)) < 0)
SELECT g AS "group", R6(sum(v)) AS volume, count(*)::INT AS facets FROM f GROUP BY g""")
def hull_volumes(spark, d):
    return H.hull_volume(X.scores(spark, d, 3), ["group"], ["PC1", "PC2", "PC3"]).select(
        "group", r6(F.col("volume")).alias("volume"), "facets")


@query("agg_11", f"""WITH {hull_sql("(SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, '1-' || label AS label FROM embeddings UNION ALL SELECT embedding[3]::DOUBLE, embedding[4]::DOUBLE, '3-' || label FROM embeddings)", 'label')}
SELECT CASE WHEN g LIKE '1-%' THEN 'PC1-PC2' ELSE 'PC3-PC4' END AS pair, split_part(g, '-', 2)::INT AS "group", count(*) AS n_rows,
R6(sum(x)) AS sum_x, R6(sum(y)) AS sum_y FROM hull GROUP BY g""")
def hull_tables(spark, d):
    pairs = T.column_pairs(X.scores(spark, d), ["PC1", "PC2", "PC3", "PC4"], ["ID", "group"])
    h = H.convex_hull(pairs, ["pair", "group"], "x", "y", "ID")
    return h.groupBy("pair", "group").agg(F.count("*").alias("n_rows"), r6(F.sum("x")).alias("sum_x"), r6(F.sum("y")).alias("sum_y"))


@query("agg_12", """WITH @cloud SELECT g, count(*) AS n, round(var_samp(x), 4) AS sxx, round(covar_samp(x, y), 2) AS sxy, round(var_samp(y)/1000, 3) AS syy, R6(corr(x, y)) AS r FROM cloud GROUP BY g""")
def covariances(spark, d):
    t = T.covariance(X.cloud(spark, d), ["g"], "x", "y")
    return t.select("g", "n", F.round("sxx", 4).alias("sxx"), F.round("sxy", 2).alias("sxy"),
                    F.round(F.col("syy") / 1000, 3).alias("syy"), r6(F.col("r")).alias("r"))


_MOM = """m AS (SELECT label AS g, count(*) AS n, avg(embedding[1]::DOUBLE) AS mx, avg(embedding[2]::DOUBLE) AS my, var_samp(embedding[1]::DOUBLE) AS sxx,
covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS sxy, var_samp(embedding[2]::DOUBLE) AS syy, corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS r
FROM embeddings GROUP BY label)"""
_CONF = f"""{_MOM}, ell AS (SELECT g, (i + 1)::INT AS seq, mx + 1.959963984540054*(sqrt(sxx*(1+r)/2)*cos(2*pi()*i/60) - sqrt(sxx*(1-r)/2)*sin(2*pi()*i/60)) AS x,
my + 1.959963984540054*(sqrt(syy*(1+r)/2)*cos(2*pi()*i/60) + sqrt(syy*(1-r)/2)*sin(2*pi()*i/60)) AS y FROM m, range(0, 60) t(i))"""


@query("agg_13", f"""WITH {_CONF} SELECT 'conf' AS kind, g, seq, R6(x) AS x, R6(y) AS y FROM ell
UNION ALL SELECT 'norm', g, (i + 1)::INT, R6(mx + rad*sqrt(sxx)*cos(2*pi()*i/51)), R6(my + rad*(sxy/sqrt(sxx)*cos(2*pi()*i/51) + sqrt(syy - sxy**2/sxx)*sin(2*pi()*i/51)))
FROM (SELECT *, sqrt(2*(n-1)/2.0*(0.05**(-2.0/(n-1)) - 1)) AS rad FROM m WHERE n > 3), range(0, 52) t(i)
UNION ALL SELECT 'cluster', g, (i + 1)::INT, R6(mx + rad*sqrt(sxx)*cos(2*pi()*i/100)), R6(my + rad*(sxy/sqrt(sxx)*cos(2*pi()*i/100) + sqrt(syy - sxy**2/sxx)*sin(2*pi()*i/100)))
FROM (SELECT *, sqrt(-2*ln(0.05)) AS rad FROM m WHERE n > 2), range(0, 101) t(i)
UNION ALL SELECT 'euclid', g, (i + 1)::INT, R6(mx + 0.95*cos(2*pi()*i/51)), R6(my + 0.95*sin(2*pi()*i/51)) FROM m, range(0, 52) t(i) WHERE n > 3""")
def ellipses(spark, d):
    s = X.scores(spark, d, 2).select(F.col("group").alias("g"), "PC1", "PC2")
    parts = {"conf": L.confidence_ellipse(s, ["g"], "PC1", "PC2"), "norm": L.group_ellipse(s, ["g"], "PC1", "PC2"),
             "cluster": L.cluster_ellipse(s, "g", "PC1", "PC2"), "euclid": L.group_ellipse(s, ["g"], "PC1", "PC2", "euclid")}
    out = None
    for k, e in parts.items():
        e = e.select(F.lit(k).alias("kind"), "g", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))
        out = e if out is None else out.unionByName(e)
    return out


@query("agg_13_robust")
def robust_ellipses(spark, d):
    s = X.scores(spark, d, 2).select(F.col("group").alias("g"), "PC1", "PC2")
    e = L.group_ellipse(s, ["g"], "PC1", "PC2", "t")
    return e.select("g", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("agg_14", f"""WITH {_CONF}, c AS (SELECT g, avg(x) AS cx, avg(y) AS cy FROM ell GROUP BY g),
v AS (SELECT g, sum((x-cx)**2) AS sxx, sum((x-cx)*(y-cy)) AS sxy, sum((y-cy)**2) AS syy FROM ell JOIN c USING (g) GROUP BY g),
t AS (SELECT g, 0.5*atan2(2*sxy, sxx-syy) AS t FROM v), a AS (SELECT g, cos(t) AS c, sin(t) AS s,
CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN 1 ELSE sign(sin(t)) END AS fu, CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE 1 END AS fv FROM t),
r AS (SELECT e.g, seq, x, y, (x*c + y*s)*fu AS u, (y*c - x*s)*fv AS w FROM ell e JOIN a USING (g))
SELECT g, "end", R6(max(x)) AS x, R6(max(y)) AS y FROM (
SELECT g, 'x_min' AS "end", arg_min(x, u) AS x, arg_min(y, u) AS y FROM r GROUP BY g UNION ALL SELECT g, 'x_max', arg_max(x, u), arg_max(y, u) FROM r GROUP BY g
UNION ALL SELECT g, 'y_min', arg_min(x, w), arg_min(y, w) FROM r GROUP BY g UNION ALL SELECT g, 'y_max', arg_max(x, w), arg_max(y, w) FROM r GROUP BY g) GROUP BY g, "end\"""")
def ellipse_ends(spark, d):
    s = X.scores(spark, d, 2).select(F.col("group").alias("g"), "PC1", "PC2")
    e = L.ellipse_axes(L.confidence_ellipse(s, ["g"], "PC1", "PC2"), ["g"])
    return e.select("g", "end", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("agg_15", """WITH e AS (SELECT label AS g, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT g, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
1.06*least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))/1.34)*pow(count(*), -0.2) AS hx,
1.06*least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))/1.34)*pow(count(*), -0.2) AS hy FROM e GROUP BY g HAVING count(*) >= 10)
SELECT g, i::INT AS ix, j::INT AS iy, R6(max(x0 + (x1-x0)*i/24)) AS x, R6(max(y0 + (y1-y0)*j/24)) AS y,
R6(sum(exp(-0.5*((x - x0 - (x1-x0)*i/24)/hx)**2 - 0.5*((y - y0 - (y1-y0)*j/24)/hy)**2))/(max(n)*max(hx)*max(hy)*2*pi())) AS z
FROM e JOIN b USING (g), range(0, 25) a(i), range(0, 25) c(j) GROUP BY g, i, j""")
def densities(spark, d):
    s = X.scores(spark, d, 2).select(F.col("group").alias("g"), "PC1", "PC2")
    z = D.density(s, ["g"], "PC1", "PC2", n_grid=25)
    return z.select("g", "ix", "iy", *[r6(F.col(c)).alias(c) for c in ("x", "y", "z")])


@query("agg_17", """SELECT count(DISTINCT user_id) AS n_files, count(*) AS n_outputs, count(*) FILTER (event_type <> 'error') AS n_ok,
count(*) FILTER (event_type = 'error') AS n_failed, R6(avg(value)) AS mean_seconds, round(sum(value), 3) AS total_seconds,
R6(avg(user_id % 100)) AS mean_width, R6(avg(event_id % 50)) AS mean_height FROM events""")
def job_summary(spark, d):
    ev = X.table(spark, d, "events").select(
        F.col("user_id").alias("input"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("value").alias("seconds"), (F.col("user_id") % 100).alias("width"), (F.col("event_id") % 50).alias("height"))
    j = T.job_summary(ev)
    return j.select("n_files", "n_outputs", "n_ok", "n_failed", r6(F.col("mean_seconds")).alias("mean_seconds"),
                    F.round("total_seconds", 3).alias("total_seconds"), r6(F.col("mean_width")).alias("mean_width"),
                    r6(F.col("mean_height")).alias("mean_height"))


@query("agg_19", "WITH @coe SELECT letter, h, R6(avg(value)) AS value FROM coe GROUP BY letter, h")
def mean_coefficients(spark, d):
    c = E.long_coefficients(E.efourier(X.outlines(spark, d), 12))
    return c.groupBy("letter", "h").agg(r6(F.avg("value")).alias("value"))


@query("agg_20", """SELECT k AS "group", count(vec_id) AS n FROM (SELECT DISTINCT l_linenumber + 5 AS k FROM lineitem) LEFT JOIN embeddings ON label = k GROUP BY k""")
def group_sizes(spark, d):
    levels = X.table(spark, d, "lineitem").select((F.col("l_linenumber") + 5).alias("group")).distinct()
    return T.group_sizes(X.scores(spark, d, 2), "group", levels).select("group", "n")


# ---- windows over tables ---------------------------------------------------------------

_SPLIT = "lower(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE upper(c_mktsegment) END || '_' || c_nationkey)"


@query("win_22", f"SELECT {_SPLIT} AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def first_occurrence(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", F.lower(F.concat_ws("_", "c_mktsegment", F.col("c_nationkey"))).alias("k"))
    return first_match(c, "c_custkey", "k").select("k", "c_custkey")


@query("win_24", """WITH @scores, s AS (SELECT avg("PC1") AS mx, avg("PC2") AS my, greatest(max("PC1"), max("PC2")) - least(min("PC1"), min("PC2")) AS span FROM scores)
SELECT "ID", R6(("PC1"-mx)/sqrt(("PC1"-mx)**2 + ("PC2"-my)**2)*span*0.05 + 0.1) AS shift_x, R6(("PC2"-my)/sqrt(("PC1"-mx)**2 + ("PC2"-my)**2)*span*0.05 - 0.2) AS shift_y FROM scores, s""")
def shifts(spark, d):
    t = T.outward_shifts(X.scores(spark, d, 2), "PC1", "PC2", 0.5, 0.1, -0.2)
    return t.select("ID", r6(F.col("shift_x")).alias("shift_x"), r6(F.col("shift_y")).alias("shift_y"))


# ---- sorts, limits -----------------------------------------------------------------------


@query("srt_02", """WITH @cloud SELECT DISTINCT id FROM (SELECT arg_min(id, (x, id)) AS id FROM cloud UNION ALL SELECT arg_max(id, (x, -id)) FROM cloud
UNION ALL SELECT arg_min(id, (y, id)) FROM cloud UNION ALL SELECT arg_max(id, (y, -id)) FROM cloud)""")
def extremes(spark, d):
    return T.axis_extremes(X.cloud(spark, d), "id", "x", "y")


def draw_runs(spark, d, fractions=(0.2, 0.5, 0.8), repeats=8):
    """``fraction, realized_n, repeat_id, similarity, shift_deg``: a run keeps rows by a portable draw."""
    s = X.scores(spark, d, 2)
    total = s.agg(F.avg("PC1").alias("m")).scalar()
    tasks = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(r).alias("repeat_id"))
                      for f in fractions for r in range(1, repeats + 1)])
    picked = s.select("ID", "PC1", "PC2", F.explode(tasks).alias("t")).select("ID", "PC1", "PC2", "t.*").filter(
        draws.uniform(5, F.col("repeat_id"), F.col("ID")) < F.col("fraction"))
    runs = picked.groupBy("fraction", "repeat_id").agg(F.avg("PC1").alias("m"), F.avg("PC2").alias("q"))
    return runs.select("fraction", F.floor(F.col("fraction") * 100).cast("bigint").alias("realized_n"), "repeat_id",
                       (1 - F.abs(F.col("m") - total)).alias("subspace_similarity"),
                       (F.abs(F.col("q")) * 100).alias("axis_shift_mean_deg"))


RUNS = """runs AS (SELECT fraction, floor(fraction*100)::BIGINT AS realized_n, r AS repeat_id, 1 - abs(avg(p1) - max(m)) AS subspace_similarity,
abs(avg(p2))*100 AS axis_shift_mean_deg FROM (SELECT vec_id, embedding[1]::DOUBLE AS p1, embedding[2]::DOUBLE AS p2 FROM embeddings),
(SELECT avg(embedding[1]::DOUBLE) AS m FROM embeddings), (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS fraction), range(1, 9) t(r)
WHERE concat('0x', substr(md5(concat_ws(':', 5, r, vec_id)), 1, 8))::BIGINT/4294967296.0 < fraction GROUP BY fraction, r)"""
SUMMARY = """summary AS (SELECT fraction, realized_n, metric_type, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd,
stddev_samp(v)/sqrt(count(*)) AS se, quantile_cont(v, 0.025) AS q025, quantile_cont(v, 0.975) AS q975 FROM (
SELECT fraction, realized_n, unnest(['subspace_similarity', 'axis_shift_mean_deg']) AS metric_type, unnest([subspace_similarity, axis_shift_mean_deg]) AS v FROM runs)
GROUP BY fraction, realized_n, metric_type)"""


@query("srt_04", f"""WITH {RUNS}, {SUMMARY}, asked AS (SELECT metric_type, NULL::DOUBLE AS thr FROM summary WHERE metric_type LIKE '%_deg'
UNION SELECT metric_type, unnest([0.999, 0.99, 0.98]) FROM summary WHERE metric_type NOT LIKE '%_deg'),
ok AS (SELECT a.metric_type, a.thr, min(fraction) AS f FROM asked a JOIN summary s ON s.metric_type = a.metric_type
AND CASE WHEN thr IS NULL THEN mean <= 1.0 ELSE mean >= thr AND sd <= 0.01 END GROUP BY a.metric_type, a.thr)
SELECT a.metric_type, R6(a.thr) AS similarity_threshold, R6(f) AS recommended_fraction, realized_n AS recommended_sample_size,
CASE WHEN a.thr IS NULL THEN 'angle' ELSE 'similarity' END AS metric_family, f IS NOT NULL AS converged
FROM asked a LEFT JOIN ok ON ok.metric_type = a.metric_type AND ok.thr IS NOT DISTINCT FROM a.thr
LEFT JOIN summary s ON s.metric_type = a.metric_type AND s.fraction = f""")
def converged(spark, d):
    from ..operators.stability import summarize_runs
    s = summarize_runs(draw_runs(spark, d), ["subspace_similarity", "axis_shift_mean_deg"])
    c = T.first_converged(s, (0.999, 0.99, 0.98), 0.01, 1.0)
    return c.select("metric_type", r6(F.col("similarity_threshold")).alias("similarity_threshold"),
                    r6(F.col("recommended_fraction")).alias("recommended_fraction"), "recommended_sample_size",
                    "metric_family", "converged")


@query("srt_05", """SELECT R6(min(f)) AS fraction, n AS realized_n FROM (SELECT f, least(greatest(2, floor(f*t)), t)::BIGINT AS n FROM
(SELECT unnest([0.001, 0.002, 0.1, 0.1001, 0.5, 1.0, 1.5])::DOUBLE AS f), (SELECT count(*) AS t FROM embeddings)) GROUP BY n""")
def schedule(spark, d):
    n = X.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    s = T.fraction_schedule(n, [0.001, 0.002, 0.1, 0.1001, 0.5, 1.0, 1.5, 0.5])
    return s.select(r6(F.col("fraction")).alias("fraction"), "realized_n")


@query("srt_06", "SELECT c_custkey, ceil(row_number() OVER (ORDER BY c_custkey)/40.0)::BIGINT AS page FROM customer")
def pages(spark, d):
    return T.paginate(X.table(spark, d, "customer").select("c_custkey"), "c_custkey", 40)


@query("srt_07", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_rows(spark, d):
    return T.head(X.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


# ---- sets ---------------------------------------------------------------------------------


def _two_sets(spark, d):
    s = X.scores(spark, d)
    p = T.column_pairs(s, ["PC1", "PC2", "PC3", "PC4"], ["ID"])
    return p.filter("ID % 2 = 0"), p.filter("ID % 2 = 1")


@query("set_01", """WITH p AS (SELECT 'PC1-PC2' AS pair, vec_id % 2 AS w, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
UNION ALL SELECT 'PC3-PC4', vec_id % 2, embedding[3]::DOUBLE, embedding[4]::DOUBLE FROM embeddings),
b AS (SELECT pair, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY pair),
c AS (SELECT pair, greatest(1, least(60, ceil((x-x0)/((x1-x0)/60)))) AS i, greatest(1, least(60, ceil((y-y0)/((y1-y0)/60)))) AS j, max(w) AS hi, min(w) AS lo FROM p JOIN b USING (pair) GROUP BY 1, 2, 3)
SELECT pair, R6(count(*) FILTER (hi = 1 AND lo = 0)/count(*)) AS iou FROM c GROUP BY pair""")
def grid_overlap(spark, d):
    a, b = _two_sets(spark, d)
    return T.cell_iou(a, b, ["pair"], 60).select("pair", r6(F.col("iou")).alias("iou"))


def overlap_sql(first, second, on):
    """Ring overlap in SQL: ``hull`` rows by g; the rings g = ``first`` are clipped by the edges of the rings g = ``second``, one edge a step."""
    r = "list_transform(range(1, len(ring) + 1), lambda i: {})"
    area = "abs(list_sum(" + r.format("ring[i].x*ring[(i % len(ring)) + 1].y - ring[(i % len(ring)) + 1].x*ring[i].y") + "))/2"
    return f"""rings AS (SELECT g, list({{'x': x, 'y': y}} ORDER BY k) AS ring FROM hull GROUP BY g),
sized AS (SELECT *, CASE WHEN len(ring) >= 3 THEN {area} ELSE 0 END AS area FROM rings),
both_ AS (SELECT a.g AS g, a.ring AS subject, b.ring AS clip, a.area AS aa, b.area AS ab FROM sized a JOIN sized b ON {on} WHERE {first} AND {second}),
cut_ AS (SELECT g, 1 AS k, subject AS ring, clip, aa, ab FROM both_ UNION ALL
SELECT g, k + 1, flatten(list_transform(range(1, len(ring) + 1), lambda i: list_filter([CASE WHEN s[i] >= 0 THEN ring[i] END,
 CASE WHEN s[i]*s[(i % len(ring)) + 1] < 0 THEN {{'x': ring[i].x + (ring[(i % len(ring)) + 1].x - ring[i].x)*(s[i]/(s[i] - s[(i % len(ring)) + 1])),
 'y': ring[i].y + (ring[(i % len(ring)) + 1].y - ring[i].y)*(s[i]/(s[i] - s[(i % len(ring)) + 1]))}} END], lambda z: z IS NOT NULL))), clip, aa, ab FROM (
 SELECT *, list_transform(ring, lambda p: (clip[(k % len(clip)) + 1].x - clip[k].x)*(p.y - clip[k].y) - (clip[(k % len(clip)) + 1].y - clip[k].y)*(p.x - clip[k].x)) AS s FROM cut_ WHERE k <= len(clip))),
iou AS (SELECT g, CASE WHEN aa > 0 AND ab > 0 THEN c/(aa + ab - c) END AS iou FROM (
 SELECT g, aa, ab, CASE WHEN len(ring) >= 3 THEN {area} ELSE 0 END AS c FROM cut_ WHERE k = len(clip) + 1))"""


_HALVES = """(SELECT 'PC1-PC2|' || vec_id % 2 AS g, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
UNION ALL SELECT 'PC3-PC4|' || vec_id % 2, embedding[3]::DOUBLE, embedding[4]::DOUBLE FROM embeddings)"""


@query("set_02", f"""WITH {hull_sql(_HALVES, 'g')}, {overlap_sql("right(a.g, 1) = '0'", "right(b.g, 1) = '1'", 'left(a.g, 7) = left(b.g, 7)')}
SELECT left(g, 7) AS pair, R6(iou) AS iou FROM iou""")
def hull_overlap(spark, d):
    from ..operators.stability import hull_iou_of
    a, b = _two_sets(spark, d)
    return hull_iou_of(a, b, ["pair"], "ID").select("pair", r6(F.col("iou")).alias("iou"))


@query("set_03", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def stacked(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("set_05", "SELECT DISTINCT label, vec_id % 3 AS third FROM embeddings")
def distinct_groups(spark, d):
    return X.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("third")).distinct()
