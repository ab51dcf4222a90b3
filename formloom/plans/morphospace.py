"""Queries mul_*, win_23 and srt_03."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.base import r6
from ..operators import pca as P
from .outline import long
from .registry import query


def _scores(spark, d):
    basis, coefs = X.model_tables(spark, d)
    return basis, coefs, P.long_scores(P.project(coefs, basis))


def _model(spark, d):
    basis, coefs = X.model_tables(spark, d)
    return basis, coefs, P.to_tables(spark, basis, 6)


# the eigenvectors must rebuild the covariance, whatever their signs
@query("mul_01", """WITH @cf SELECT a.pos::INT AS i, b.pos::INT AS j, R6(covar_samp(a.value, b.value)) AS cov FROM cf a JOIN cf b
ON a.id = b.id AND a.pos <= b.pos GROUP BY a.pos, b.pos""")
def pca_covariance(spark, d):
    _, coefs = X.model_tables(spark, d)
    m = P.to_tables(spark, P.fit(coefs), 6)
    a = m.rotation.join(m.sdev.select("pc", "sdev"), "pc").select("pc", F.col("pos").alias("i"), (
        F.col("loading") * F.col("sdev") * F.col("sdev")).alias("u"))
    b = m.rotation.select("pc", F.col("pos").alias("j"), F.col("loading").alias("w"))
    return a.join(b, "pc").filter("i <= j").groupBy("i", "j").agg(r6(F.sum(F.col("u") * F.col("w"))).alias("cov"))


@query("mul_01_scores", """WITH @cf, n AS (SELECT pos, var_samp(value) AS v FROM cf GROUP BY pos) SELECT R6(sum(v)) AS total_variance, R6(0.0::DOUBLE) AS mean_score FROM n""")
def pca_scores(spark, d):
    _, coefs = X.model_tables(spark, d)
    s = P.long_scores(P.project(coefs, P.fit(coefs)))
    v = s.groupBy("pc").agg(F.var_samp("score").alias("v"), F.avg("score").alias("m"))
    return v.agg(r6(F.sum("v")).alias("total_variance"), r6(F.sum("m")).alias("mean_score"))


@query("mul_02", "WITH @sc SELECT id, pc, R6(score) AS score FROM sc")
def reprojected(spark, d):
    basis, coefs = X.model_tables(spark, d)
    moved = P.Basis(basis.center * 0.5, basis.rotation, basis.sdev)
    s = P.long_scores(P.reproject(coefs, moved))
    return s.select("id", "pc", r6(F.col("score")).alias("score"))


@query("mul_03", """WITH @mn, @rot SELECT id, pc::INT AS pc, R6(sum((value - 0.5*m)*loading)) AS score FROM cf JOIN mn USING (pos) JOIN rot USING (pos) GROUP BY id, pc""")
def projected(spark, d):
    basis, coefs = X.model_tables(spark, d)
    s = P.long_scores(P.project(coefs, P.Basis(basis.center * 0.5, basis.rotation, basis.sdev)))
    return s.select("id", "pc", r6(F.col("score")).alias("score"))


@query("mul_04", """WITH @sc SELECT 'score' AS part, id, pc, R6(CASE WHEN pc IN (1, 3) THEN -score ELSE score END) AS value FROM sc
UNION ALL SELECT 'loading', pos, pc::INT, R6(CASE WHEN pc IN (1, 3) THEN -loading ELSE loading END) FROM rot""")
def flipped(spark, d):
    basis, coefs, s = _scores(spark, d)
    m, t = P.flip_axes(P.to_tables(spark, basis, 6), s, [1, 3])
    return t.select(F.lit("score").alias("part"), "id", "pc", r6(F.col("score")).alias("value")).unionByName(
        m.rotation.select(F.lit("loading").alias("part"), F.col("pos").cast("bigint").alias("id"), "pc", r6(F.col("loading")).alias("value")))


def inverse_sql(src, keys, pts, h=6):
    """Outline of coefficients ``(keys, pos, v)`` with numbered positions."""
    k = ", ".join(keys)
    return f"""inv AS (SELECT {k}, k, sum(CASE WHEN pos <= {h} THEN v*cos(2*pi()*pos*k/{pts}) WHEN pos <= {2 * h} THEN v*sin(2*pi()*(pos-{h})*k/{pts}) ELSE 0 END) AS x,
sum(CASE WHEN pos > {3 * h} THEN v*sin(2*pi()*(pos-{3 * h})*k/{pts}) WHEN pos > {2 * h} THEN v*cos(2*pi()*(pos-{2 * h})*k/{pts}) ELSE 0 END) AS y FROM {src}, range(0, {pts}) t(k) GROUP BY {k}, k)"""


_AT = """pat AS (SELECT id, max(score) FILTER (pc = 1) AS px, max(score) FILTER (pc = 2) AS py FROM sc GROUP BY id),
co AS (SELECT id, pos, max(m) + sum(loading*CASE WHEN pc = 1 THEN px ELSE py END) AS v FROM pat, rot JOIN mn USING (pos) WHERE pc <= 2 GROUP BY id, pos)"""


def _positions(s):
    return s.groupBy("id").agg(F.max(F.when(F.col("pc") == 1, F.col("score"))).alias("x"),
                               F.max(F.when(F.col("pc") == 2, F.col("score"))).alias("y"))


@query("mul_05", f"""WITH @sc, {_AT}, {inverse_sql('co', ['id'], 24)}, c AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM inv GROUP BY id)
SELECT inv.id, (k + 1)::INT AS seq, R6(x + px - cx) AS x, R6(y + py - cy) AS y FROM inv JOIN c USING (id) JOIN pat USING (id)""")
def shapes_at(spark, d):
    basis, _, s = _scores(spark, d)
    return long(P.shapes_at(_positions(s), basis, (1, 2), nb_pts=24), F.col("shape"))


@query("mul_06", f"""WITH @sc, {_AT} SELECT a.id, a.pos::INT AS seq, R6(a.v) AS x, R6(b.v) AS y FROM co a JOIN co b ON a.id = b.id AND b.pos = a.pos + 12""")
def landmarks_at(spark, d):
    basis, _, s = _scores(spark, d)
    return long(P.landmarks_at(_positions(s), basis, (1, 2)), F.col("shape"))


_REQ = """co AS (SELECT vec_id AS id, pos, max(m) + sum(loading*sdev*embedding[pc]::DOUBLE) AS v FROM embeddings, rot JOIN mn USING (pos) JOIN sdv USING (pc) WHERE pc <= 3 GROUP BY vec_id, pos)"""


@query("mul_07", f"""WITH @sdv, {_REQ}, {inverse_sql('co', ['id'], 24)} SELECT id, (k + 1)::INT AS seq, R6(x) AS x, R6(y) AS y FROM inv""")
def reconstructed(spark, d):
    basis, _ = X.model_tables(spark, d)
    req = X.scores(spark, d, 3).select(F.col("ID").alias("id"), F.array("PC1", "PC2", "PC3").alias("scores"))
    return long(P.reconstruct(req, basis, nb_pts=24), F.col("shape"))


@query("mul_08", f"""WITH @sdv, co AS (SELECT vec_id AS id, s AS step, pos, max(m) + sum(loading*sdev*CASE pc WHEN 1 THEN embedding[1]::DOUBLE ELSE -2 + s*2.0 END) AS v
FROM embeddings, range(0, 3) r(s), rot JOIN mn USING (pos) JOIN sdv USING (pc) WHERE pc IN (1, 3) GROUP BY vec_id, s, pos),
{inverse_sql('co', ['id', 'step'], 12)} SELECT id, step::INT AS step, (k + 1)::INT AS seq, R6(x) AS x, R6(y) AS y FROM inv""")
def swept(spark, d):
    basis, _ = X.model_tables(spark, d)
    base = X.scores(spark, d, 1).select(F.col("ID").alias("id"), F.array("PC1").alias("scores"))
    return long(P.reconstruct(P.sweep(base, "scores", 3, -2, 2, 3), basis, nb_pts=12), F.col("shape"), "id", "step")


@query("mul_09", f"""WITH @sdv, co AS (SELECT q.pc, sd, pos, m + loading*sdev*sd AS v FROM (SELECT unnest([1, 2, 3]) AS pc) q, (SELECT unnest([-2.0, 0.0, 1.5]) AS sd), rot JOIN mn USING (pos) JOIN sdv ON sdv.pc = rot.pc WHERE rot.pc = q.pc),
{inverse_sql('co', ['pc', 'sd'], 40)}, c AS (SELECT pc, sd, avg(x) AS cx, avg(y) AS cy FROM inv GROUP BY pc, sd),
z AS (SELECT * FROM inv UNION ALL SELECT pc, sd, 40, x, y FROM inv WHERE k = 0)
SELECT z.pc::INT AS pc, R6(z.sd::DOUBLE) AS sd, (k + 1)::INT AS seq, R6(x - cx) AS x, R6(y - cy) AS y FROM z JOIN c ON c.pc = z.pc AND c.sd = z.sd""")
def contributions(spark, d):
    basis, _ = X.model_tables(spark, d)
    c = P.contributions(spark, basis, [1, 2, 3], [-2.0, 0.0, 1.5], nb_pts=40)
    return long(c, F.col("shape"), "pc", "sd")


_GRID = """b AS (SELECT min("PC1") AS x0, max("PC1") AS x1, min("PC2") AS y0, max("PC2") AS y1 FROM scores)"""


@query("mul_10", f"""WITH @scores, {_GRID}, m AS (SELECT avg("PC1") AS mx, avg("PC2") AS my, var_samp("PC1") AS sxx, var_samp("PC2") AS syy, corr("PC1", "PC2") AS r FROM scores),
c AS (SELECT sqrt(avg(("PC1"-mx)**2 + ("PC2"-my)**2)) AS r FROM scores, m)
SELECT 'range' AS kind, R6(x0 + (x1-x0)*i/5) AS x, R6(y0 + (y1-y0)*j/4) AS y FROM b, range(0, 6) u(i), range(0, 5) w(j)
UNION ALL SELECT 'circle', R6(r*cos(2*pi()*i/12)), R6(r*sin(2*pi()*i/12)) FROM c, range(0, 12) u(i)
UNION ALL SELECT 'confell', R6(mx + 0.674489750196082*(sqrt(sxx*(1+r)/2)*cos(2*pi()*i/12) - sqrt(sxx*(1-r)/2)*sin(2*pi()*i/12))),
R6(my + 0.674489750196082*(sqrt(syy*(1+r)/2)*cos(2*pi()*i/12) + sqrt(syy*(1-r)/2)*sin(2*pi()*i/12))) FROM m, range(0, 12) u(i)
UNION ALL SELECT 'xy', R6("PC1"), R6("PC2") FROM scores""")
def positions(spark, d):
    s = X.scores(spark, d, 2)
    out = None
    for kind in ("range", "circle", "confell", "xy"):
        p = P.positions(s, "PC1", "PC2", kind).select(F.lit(kind).alias("kind"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))
        out = p if out is None else out.unionByName(p)
    return out


@query("mul_11", f"""WITH @sc, b AS (SELECT min(score) FILTER (pc = 1) AS x0, max(score) FILTER (pc = 1) AS x1, min(score) FILTER (pc = 2) AS y0, max(score) FILTER (pc = 2) AS y1 FROM sc),
pat AS (SELECT i, j, x0 + (x1-x0)*i/5 AS px, y0 + (y1-y0)*j/4 AS py FROM b, range(0, 6) u(i), range(0, 5) w(j)),
co AS (SELECT i, j, pos, max(m) + sum(loading*CASE WHEN pc = 1 THEN px ELSE py END) AS v FROM pat, rot JOIN mn USING (pos) WHERE pc <= 2 GROUP BY i, j, pos),
{inverse_sql('co', ['i', 'j'], 60)}, s AS (SELECT i, j, avg(x) AS cx, avg(y) AS cy, least(1/(max(x)-min(x)), 1/(max(y)-min(y))) AS f FROM inv GROUP BY i, j)
SELECT R6(px) AS px, R6(py) AS py, (k/2 + 1)::INT AS seq, R6((x - cx)*f + px) AS x, R6((y - cy)*f + py) AS y FROM inv JOIN s USING (i, j) JOIN pat USING (i, j) WHERE k % 2 = 0""")
def morphospace(spark, d):
    basis, _, s = _scores(spark, d)
    m = P.morphospace(P.positions(_positions(s), "x", "y", "range"), basis, (1, 2), shown=30)
    return long(m.select(r6(F.col("x")).alias("px"), r6(F.col("y")).alias("py"), "shape"), F.col("shape"), "px", "py")


@query("mul_12", """WITH @sc, q AS (SELECT pc, median(score) AS mid, stddev_samp(score) AS sd FROM sc WHERE pc <= 3 GROUP BY pc)
SELECT DISTINCT id FROM sc JOIN q USING (pc) WHERE exp(-0.5*((score-mid)/sd)**2)/(sd*sqrt(2*pi())) < 0.5""")
def outliers(spark, d):
    _, _, s = _scores(spark, d)
    return P.outliers(s, conf=0.5, nax=3)


@query("mul_12_landmarks", """WITH @pts, l AS (SELECT id, seq, unnest(['x', 'y']) AS coordinate, unnest([x, y]) AS v FROM pts),
q AS (SELECT seq, coordinate, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY seq, coordinate)
SELECT id, seq, coordinate FROM l JOIN q USING (seq, coordinate) WHERE sd > 1e-9 AND exp(-0.5*((v-m)/sd)**2)/(sd*sqrt(2*pi())) < 0.1""")
def landmark_outliers(spark, d):
    p = X.points(spark, d).select("id", "seq", "x", "y")
    out = P.landmark_outliers(p, 0.1)
    # axis points have no spread in one coordinate
    flat = p.groupBy("seq").agg(F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return out.join(flat, "seq").filter(F.when(F.col("coordinate") == "x", F.col("sx")).otherwise(F.col("sy")) > 1e-9).select(
        "id", "seq", "coordinate")


@query("mul_13", "WITH @sdv SELECT pc, R6(100*sdev**2/(SELECT sum(sdev**2) FROM sdv)) AS variance_pct FROM sdv")
def variance(spark, d):
    _, _, m = _model(spark, d)
    return m.sdev.select("pc", r6(F.col("variance_pct")).alias("variance_pct"))


_SCREE = """scree AS (SELECT pc AS axis, sdev**2/(SELECT sum(sdev**2) FROM sdv) AS proportion, sum(sdev**2) OVER (ORDER BY pc)/(SELECT sum(sdev**2) FROM sdv) AS cumsum FROM sdv)"""


@query("win_23", f"WITH @sdv, {_SCREE} SELECT axis, R6(proportion) AS proportion, R6(cumsum) AS cumsum FROM scree")
def scree(spark, d):
    t = P.scree(_model(spark, d)[2].sdev)
    return t.select("axis", r6(F.col("proportion")).alias("proportion"), r6(F.col("cumsum")).alias("cumsum"))


@query("srt_03", f"WITH @sdv, {_SCREE} SELECT coalesce(min(axis) FILTER (cumsum >= 0.8), count(*))::INT AS axes FROM scree")
def axes_needed(spark, d):
    return P.scree_min(P.scree(_model(spark, d)[2].sdev), 0.8)


@query("mul_14", f"WITH @sdv, {_SCREE} SELECT axis, R6(proportion) AS proportion, R6(cumsum) AS cumsum FROM scree WHERE axis <= (SELECT coalesce(min(axis) FILTER (cumsum >= 0.9), count(*)) FROM scree)")
def scree_plot(spark, d):
    t = P.scree_plot(P.scree(_model(spark, d)[2].sdev), 0.9)
    return t.select("axis", r6(F.col("proportion")).alias("proportion"), r6(F.col("cumsum")).alias("cumsum"))
