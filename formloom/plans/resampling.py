"""Queries res_*, agg_18, jon_07, jon_08 and srt_08."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import draws as DR
from ..functions import efa as E
from ..functions.base import r6
from ..operators import gaps as G
from ..operators import pca as P
from ..operators import resample as R
from ..operators import stability as S
from ..operators import tables as T
from .morphospace import inverse_sql
from .outline import long
from .registry import query
from .tables import RUNS, SUMMARY, draw_runs, hull_sql, overlap_sql

N = "(SELECT count(*) FROM embeddings)"


def u_sql(*parts):
    return f"(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT/4294967296.0)"


# ---- draws ---------------------------------------------------------------------------


@query("res_01", f"""SELECT b, k, (floor({u_sql('11', 'b', 'k')}*{N}) + 1)::BIGINT AS idx FROM range(1, 6) u(b), (SELECT row_number() OVER () AS k FROM embeddings)""")
def draws(spark, d):
    n = X.table(spark, d, "embeddings").count()
    return R.bootstrap(spark, n, 5, n, 11)


@query("res_02", f"""WITH t AS (SELECT f AS fraction, greatest(2, floor(f*{N}))::BIGINT AS realized_n, r AS repeat_id FROM (SELECT unnest([0.1, 0.37, 0.8])::DOUBLE AS f), range(1, 4) u(r)),
h AS (SELECT t.*, vec_id AS id, row_number() OVER (PARTITION BY fraction, repeat_id ORDER BY md5(concat_ws(':', 3, round(fraction*100000)::BIGINT, repeat_id, vec_id))) AS rn FROM embeddings, t)
SELECT R6(fraction) AS fraction, repeat_id::INT AS repeat_id, id FROM h WHERE rn <= realized_n""")
def samples(spark, d):
    ids = X.outlines(spark, d).select("id")
    t = S.tasks(ids.agg(F.count("*").alias("n")), [0.1, 0.37, 0.8], 3)
    s = S.draw_samples(ids, t, 3)
    return s.select(r6(F.col("fraction")).alias("fraction"), "repeat_id", "id")


@query("res_03", f"""SELECT DISTINCT CASE WHEN s <= 1 THEN round_even(s*{N}, 0) ELSE s END::BIGINT AS size FROM (SELECT unnest([0.001, 0.1, 0.25, 0.5, 1.0, 60, 100000000])::DOUBLE AS s)
WHERE CASE WHEN s <= 1 THEN round_even(s*{N}, 0) ELSE s END BETWEEN 5 AND {N}""")
def size_schedule(spark, d):
    n = X.table(spark, d, "embeddings").count()
    sizes = R.size_schedule([0.001, 0.1, 0.25, 0.5, 1.0, 60, 100000000], n)
    return X.table(spark, d, "embeddings").agg(F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias("s")).select(
        F.explode("s").alias("size"))


# ---- saturation ------------------------------------------------------------------------

_SIZES = [i / 10 for i in range(1, 11)]
_PCMAX = ", ".join(f"max(embedding[{i}]::DOUBLE) - min(embedding[{i}]::DOUBLE) AS r{i}" for i in range(1, 9))
_SAT = f"""idx AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, embedding FROM embeddings),
sizes AS (SELECT round_even(f*{N}, 0)::BIGINT AS s FROM (SELECT unnest({_SIZES})::DOUBLE AS f)),
dr AS (SELECT s, b, (floor({u_sql('2', 's', 'b', 'k')}*{N}) + 1)::BIGINT AS i FROM sizes, range(1, 201) u(b), (SELECT row_number() OVER () AS k FROM embeddings) WHERE k <= s),
rg AS (SELECT s, b, {_PCMAX} FROM dr JOIN idx USING (i) GROUP BY s, b),
mt AS (SELECT s, unnest(['total_variance', 'cumulative_variance']) AS metric_type, unnest([{' + '.join(f'r{i}' for i in range(1, 9))}, exp(({' + '.join(f'ln(r{i})' for i in range(1, 9))})/8)]) AS v FROM rg),
sat AS (SELECT s AS sample_size, metric_type, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd, quantile_cont(v, 0.025) AS q025, quantile_cont(v, 0.975) AS q975,
s::DOUBLE/{N} AS sample_proportion FROM mt GROUP BY s, metric_type)"""
_SATCOLS = "sample_size, metric_type, R6(mean) AS mean, R6(median) AS median, R6(sd) AS sd, R6(q025) AS q025, R6(q975) AS q975, R6(sample_proportion) AS sample_proportion"


def _saturation(spark, d):
    s = R.saturation(X.scores(spark, d), _SIZES, seed=2)
    return s.withColumn("sample_size", F.col("sample_size").cast("bigint"))


@query("res_04", f"WITH {_SAT} SELECT {_SATCOLS} FROM sat")
def saturation(spark, d):
    s = _saturation(spark, d)
    return s.select("sample_size", "metric_type", *[r6(F.col(c)).alias(c) for c in (
        "mean", "median", "sd", "q025", "q975", "sample_proportion")])


@query("res_05", f"WITH {_SAT} SELECT sample_size, metric_type, R6(100*mean/max(mean) OVER (PARTITION BY metric_type)) AS pct FROM sat")
def relative_saturation(spark, d):
    return R.relative_saturation(_saturation(spark, d)).select("sample_size", "metric_type", r6(F.col("pct")).alias("pct"))


# ---- stability --------------------------------------------------------------------------


@query("res_06")
def stability(spark, d):
    runs, _, _ = S.stability(X.outlines(spark, d), [0.3, 0.7], 2, nb_h=6, resolution=20)
    keep = ["fraction", "realized_n", "repeat_id"]
    return runs.select(*keep, *[r6(F.col(c)).alias(c) for c in runs.columns if c not in keep])


@query("res_07")
def subspace(spark, d):
    runs, _, _ = S.stability(X.outlines(spark, d), [0.3, 0.7], 2, nb_h=6, resolution=20, mode="strict")
    return runs.select("fraction", "realized_n", "repeat_id", r6(F.col("subspace_similarity")).alias("subspace_similarity"))


_LOAD = """ld AS (SELECT vec_id % 3 AS run, label + 1 AS pc, s AS pos, avg(embedding[s]::DOUBLE) AS loading FROM embeddings, range(1, 25) t(s) GROUP BY 1, 2, 3),
rf AS (SELECT label + 1 AS pc, s AS pos, avg(embedding[s]::DOUBLE) AS loading FROM embeddings, range(1, 25) t(s) GROUP BY 1, 2)"""


@query("res_08", f"""WITH {_LOAD}, s AS (SELECT run, pc, least(abs(sum(a.loading*b.loading)/sqrt(sum(a.loading**2)*sum(b.loading**2))), 1.0) AS sim FROM ld a JOIN rf b USING (pc, pos) GROUP BY run, pc)
SELECT run, pc, R6(sim) AS similarity, R6(acos(sim)*180/pi()) AS angle_deg FROM s""")
def axis_shift(spark, d):
    e = X.table(spark, d, "embeddings").select(
        (F.col("vec_id") % 3).alias("run"), (F.col("label") + 1).alias("pc"), F.posexplode(F.slice("embedding", 1, 24)).alias("p", "v"))
    e = e.select("run", "pc", (F.col("p") + 1).alias("pos"), F.col("v").cast("double").alias("v"))
    mine = e.groupBy("run", "pc", "pos").agg(F.avg("v").alias("loading"))
    ref = e.groupBy("pc", "pos").agg(F.avg("v").alias("loading"))
    a = S.axis_shift(mine, ref, ["run"])
    return a.select("run", "pc", r6(F.col("similarity")).alias("similarity"), r6(F.col("angle_deg")).alias("angle_deg"))


_AXES = [("PC1-PC2", 1, 2), ("PC1-PC3", 1, 3), ("PC2-PC3", 2, 3)]
_OCC = " UNION ALL ".join(f"SELECT '{p}' AS pair, label AS run, embedding[{i}]::DOUBLE AS x, embedding[{j}]::DOUBLE AS y FROM embeddings" for p, i, j in _AXES)
_RUN_HULLS = hull_sql(f"(SELECT pair || '|' || run AS g, x, y FROM ({_OCC}) UNION ALL SELECT pair || '|all', x, y FROM ({_OCC}))", "g")
_RUN_IOU = overlap_sql("right(a.g, 3) <> 'all'", "right(b.g, 3) = 'all'", "left(a.g, 7) = left(b.g, 7)")


@query("res_09", f"""WITH {_RUN_HULLS}, {_RUN_IOU}, p AS ({_OCC}), b AS (SELECT pair, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY pair),
c AS (SELECT DISTINCT pair, run, greatest(1, least(60, ceil((x-x0)/((x1-x0)/60)))) AS i, greatest(1, least(60, ceil((y-y0)/((y1-y0)/60)))) AS j FROM p JOIN b USING (pair)),
n AS (SELECT pair, count(*) AS whole FROM (SELECT DISTINCT pair, i, j FROM c) GROUP BY pair),
gi AS (SELECT run, avg(k/whole) AS grid_iou FROM (SELECT pair, run, count(*) AS k FROM c GROUP BY pair, run) JOIN n USING (pair) GROUP BY run),
hi AS (SELECT substr(g, 9)::INT AS run, avg(iou) AS hull_iou FROM iou GROUP BY run)
SELECT run::INT AS "group", R6(grid_iou) AS grid_iou, R6(hull_iou) AS hull_iou, R6((grid_iou + hull_iou)/2) AS combined_available, R6((grid_iou + hull_iou)/2) AS combined_strict FROM gi JOIN hi USING (run)""")
def occupancy(spark, d):
    s = X.scores(spark, d, 3).withColumnRenamed("ID", "id").select("id", "group", "PC1", "PC2", "PC3")
    o = S.occupancy(s, s.drop("group"), ["group"], ["PC1", "PC2", "PC3"])
    return o.select("group", *[r6(F.col(c)).alias(c) for c in ("grid_iou", "hull_iou", "combined_available", "combined_strict")])


_SUM = "R6(mean) AS mean, R6(median) AS median, R6(sd) AS sd, R6(se) AS se, R6(q025) AS q025, R6(q975) AS q975"


@query("res_10", f"WITH {RUNS}, {SUMMARY} SELECT R6(fraction) AS fraction, realized_n, metric_type, {_SUM} FROM summary")
def run_summary(spark, d):
    s = S.summarize_runs(draw_runs(spark, d))
    return s.select(r6(F.col("fraction")).alias("fraction"), "realized_n", "metric_type",
                    *[r6(F.col(c)).alias(c) for c in ("mean", "median", "sd", "se", "q025", "q975")])


@query("res_11", f"WITH {RUNS}, {SUMMARY} SELECT metric_type, R6(realized_n::DOUBLE) AS x, R6(mean) AS mean, R6(q025) AS q025, R6(q975) AS q975 FROM summary WHERE metric_type = 'subspace_similarity'")
def convergence(spark, d):
    c = S.convergence_curve(S.summarize_runs(draw_runs(spark, d)), ["subspace_similarity"], "count")
    return c.select("metric_type", *[r6(F.col(k)).alias(k) for k in ("x", "mean", "q025", "q975")])


@query("res_12", f"""WITH {RUNS}, l AS (SELECT fraction, realized_n, unnest([1, 2]) AS axis, unnest([axis_shift_mean_deg, 90*subspace_similarity]) AS v FROM runs)
SELECT R6(fraction) AS fraction, realized_n, axis::INT AS axis, R6(avg(v)) AS mean, R6(quantile_cont(v, 0.025)) AS q025, R6(quantile_cont(v, 0.975)) AS q975 FROM l GROUP BY fraction, realized_n, axis""")
def axis_summary(spark, d):
    runs = draw_runs(spark, d).select("fraction", "realized_n", F.col("axis_shift_mean_deg").alias("axis_pc1_deg"),
                                      (F.col("subspace_similarity") * 90).alias("axis_pc2_deg"))
    a = S.axis_summary(runs, 4)
    return a.select(r6(F.col("fraction")).alias("fraction"), "realized_n", "axis", *[r6(F.col(k)).alias(k) for k in ("mean", "q025", "q975")])


def _closed(src, keys, pts):
    k = ", ".join(keys)
    return f"""{inverse_sql(src, keys, pts)}, c AS (SELECT {k}, avg(x) AS cx, avg(y) AS cy FROM inv GROUP BY {k}),
z AS (SELECT * FROM inv UNION ALL SELECT {k}, {pts}, x, y FROM inv WHERE k = 0)"""


@query("res_13", f"""WITH @cf, co AS (SELECT label AS run, pos, avg(value) AS v FROM cf GROUP BY label, pos), {_closed('co', ['run'], 40)}
SELECT run, (k + 1)::INT AS seq, R6(x - cx) AS x, R6(y - cy) AS y FROM z JOIN c USING (run)""")
def mean_shapes(spark, d):
    c = E.efourier(X.outlines(spark, d), 6).withColumnRenamed("label", "run")
    return long(S.mean_shapes(c, ["run"], 40), F.col("shape"), "run")


@query("res_14", f"""WITH @cf, @rot, co AS (SELECT run, q.pc, sd, pos, v + sd*0.1*q.pc*loading AS v FROM (SELECT label AS run, pos, avg(value) AS v FROM cf GROUP BY label, pos) m JOIN rot USING (pos)
JOIN (SELECT unnest([1, 2]) AS pc) q ON q.pc = rot.pc, (SELECT unnest([-1.0, 0.0, 2.0]) AS sd)), {_closed('co', ['run', 'pc', 'sd'], 24)}
SELECT z.run, z.pc::INT AS pc, R6(z.sd::DOUBLE) AS sd, (k + 1)::INT AS seq, R6(x - cx) AS x, R6(y - cy) AS y FROM z JOIN c ON c.run = z.run AND c.pc = z.pc AND c.sd = z.sd""")
def replicates(spark, d):
    from ..functions.base import double_array
    c = E.efourier(X.outlines(spark, d), 6)
    long_c = c.select(F.col("label").alias("run"), F.posexplode("coe").alias("p", "v")).groupBy("run", "p").agg(F.avg("v").alias("v"))
    center = long_c.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e["v"]).alias("center"))
    models = center.withColumn("rotation", double_array(P.cosine_basis(24, 2).ravel())).withColumn("sdev", double_array([0.1, 0.2]))
    r = S.replicate_shapes(models, ["run"], [1, 2], [-1.0, 2.0], 24)
    return long(r, F.col("shape"), "run", "pc", "sd")


# ---- gaps -----------------------------------------------------------------------------------

RES = 150  # the defaults of the analysis: grid, noise draws, bootstraps
MC, BOOTS = 100, 200
THRESHOLDS = (0.8, 0.9, 0.95)
_PAIRS = ("PC1", "PC2", "PC3")


def _points(spark, d, pcs=_PAIRS):
    s = X.scores(spark, d, 3).withColumnRenamed("ID", "id")
    return T.column_pairs(s, pcs, ["id"], all_pairs=True)


PTS = """pp AS (SELECT 'PC1-PC2' AS pair, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
UNION ALL SELECT 'PC1-PC3', vec_id, embedding[1]::DOUBLE, embedding[3]::DOUBLE FROM embeddings UNION ALL SELECT 'PC2-PC3', vec_id, embedding[2]::DOUBLE, embedding[3]::DOUBLE FROM embeddings)"""
ONE = """pp AS (SELECT 'PC1-PC2' AS pair, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"""


def _grid(points=PTS, res=RES):
    return f"""{points}, gr AS (SELECT pair, min(x) - 0.05*(max(x)-min(x)) AS gx, min(y) - 0.05*(max(y)-min(y)) AS gy, (max(x)-min(x))*1.1/{res - 1} AS dx, (max(y)-min(y))*1.1/{res - 1} AS dy,
max(x)-min(x) AS sx, max(y)-min(y) AS sy FROM pp GROUP BY pair),
cl AS (SELECT pair, i::INT AS ix, j::INT AS iy, gx + i*dx AS x, gy + j*dy AS y FROM gr, range(0, {res}) u(i), range(0, {res}) w(j))"""


GRID = _grid()


@query("res_16", f"WITH {GRID} SELECT pair, ix, iy, R6(x) AS x, R6(y) AS y FROM cl")
def analysis_grid(spark, d):
    g = G.grid(_points(spark, d), RES, 0.05)
    return G.cells(g, RES).select("pair", "ix", "iy", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


_RING = hull_sql("(" + PTS[PTS.index("(") + 1:-1] + ")", "pair")
_EDGE = """eg AS (SELECT g AS pair, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
FROM hull WINDOW w AS (PARTITION BY g ORDER BY k)),
sd AS (SELECT c.pair, ix, iy, min((bx-ax)*(c.y-ay) - (by_-ay)*(c.x-ax)) AS turn, min(sqrt((c.x - ax - t*(bx-ax))**2 + (c.y - ay - t*(by_-ay))**2)) AS d FROM (
SELECT c.*, ax, ay, bx, by_, least(greatest(((c.x-ax)*(bx-ax) + (c.y-ay)*(by_-ay))/((bx-ax)**2 + (by_-ay)**2), 0), 1) AS t FROM cl c JOIN eg USING (pair)) c GROUP BY c.pair, ix, iy)"""


@query("res_17", f"WITH {_RING}, {GRID}, {_EDGE} SELECT sd.pair, ix, iy, turn > 0 AS inside FROM sd JOIN gr USING (pair) WHERE turn > 0 OR d < 0.05*(sx + sy)/2")
def domain(spark, d):
    p = _points(spark, d)
    g = G.grid(p, RES, 0.05)
    ring = G.domain_polygon(p)
    c = G.domain_cells(G.cells(g, RES), ring, g, 0.05)
    return c.join(ring, "pair").select("pair", "ix", "iy", G.in_polygon(F.col("x"), F.col("y"), F.col("ring"), F.lit(0.0)).alias("inside"))


_NEAR = """nr AS (SELECT a.* FROM pp a WHERE EXISTS (SELECT 1 FROM pp b WHERE b.pair = a.pair AND b.id <> a.id AND sqrt((a.x - b.x)**2 + (a.y - b.y)**2) <= 0.03))"""
_RING_NEAR = hull_sql("(SELECT * FROM nr)", "pair").replace("RECURSIVE ", "", 1)


@query("res_17_alpha", f"WITH RECURSIVE {PTS}, {_NEAR}, {_RING_NEAR}, {GRID[len(PTS) + 2:]}, {_EDGE} SELECT sd.pair, ix, iy, turn > 0 AS inside FROM sd JOIN gr USING (pair) WHERE turn > 0 OR d < 0.05*(sx + sy)/2")
def alpha_domain(spark, d):
    p = _points(spark, d)
    g = G.grid(p, RES, 0.05)
    ring = G.domain_polygon(p, "alpha", 0.015)
    c = G.domain_cells(G.cells(g, RES), ring, g, 0.05)
    return c.join(ring, "pair").select("pair", "ix", "iy", G.in_polygon(F.col("x"), F.col("y"), F.col("ring"), F.lit(0.0)).alias("inside"))


@query("jon_08", f"WITH {_RING}, {GRID}, {_EDGE} SELECT pair, ix, iy FROM sd WHERE turn > 0")
def cells_in_hull(spark, d):
    p = _points(spark, d)
    g = G.grid(p, RES, 0.05)
    return G.domain_cells(G.cells(g, RES), G.domain_polygon(p), g, 0.0).select("pair", "ix", "iy")


@query("res_18", f"WITH {GRID} SELECT pair, count(*) AS n_cells, R6(min(x)) AS x0, R6(max(x)) AS x1, R6(min(y)) AS y0, R6(max(y)) AS y1 FROM cl GROUP BY pair")
def full_domain(spark, d):
    c = G.cells(G.grid(_points(spark, d), RES, 0.05), RES)
    return c.groupBy("pair").agg(F.count("*").alias("n_cells"), *[r6(f(c)).alias(n) for f, c, n in (
        (F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))])


def _mix(src, value, h="h"):
    """The draws of ``functions.draws.mixed`` in SQL, step by step over a column."""
    steps = (f"({h} + ({value})::BIGINT*{DR.STEP}) & {DR.MASK}", f"(xor({h}, {h} >> 16)*{DR.FIRST}) & {DR.MASK}", f"(xor({h}, {h} >> 13)*{DR.SECOND}) & {DR.MASK}", f"xor({h}, {h} >> 16)")
    for e in steps:
        src = f"(SELECT * REPLACE ({e} AS {h}) FROM {src})"
    return src


def _keyed(src, seed):
    return f"(SELECT *, concat('0x', substr(md5(concat_ws(':', {seed}, pair, id)), 1, 8))::BIGINT AS h FROM {src})"


def _uniforms(src):
    src = f"(SELECT *, h AS h1, h AS h2, h AS h3, h AS h4 FROM {src})"
    for i in range(1, 5):
        src = _mix(src, i, f"h{i}")
    return f"(SELECT *, h1/4294967296.0::DOUBLE AS u1, h2/4294967296.0::DOUBLE AS u2, h3/4294967296.0::DOUBLE AS u3, h4/4294967296.0::DOUBLE AS u4 FROM {src})"


def _moved(src):
    """Adds the noisy position px, py of every draw h, with the grid's columns."""
    return (f"(SELECT *, x + sqrt(-2*ln(greatest(u1, pow(2.0, -33))))*cos(2*pi()*u2)*0.05*sx/1.96 AS px, y + sqrt(-2*ln(greatest(u3, pow(2.0, -33))))*cos(2*pi()*u4)*0.05*sy/1.96 AS py "
            f"FROM {_uniforms(src)})")


@query("res_19", f"""WITH {GRID} SELECT pair, id, R6(px) AS gx, R6(py) AS gy, R6(x + (u1*2 - 1)*0.05*sx) AS ux, R6(y + (u3*2 - 1)*0.05*sy) AS uy FROM {_moved("(SELECT * FROM " + _keyed('pp', 4) + " JOIN gr USING (pair))")}""")
def perturbed(spark, d):
    p = _points(spark, d)
    rows = p.join(G.grid(p, RES, 0.05), "pair")
    a = G.perturb(rows, 0.05, 4).select("pair", "id", r6(F.col("x")).alias("gx"), r6(F.col("y")).alias("gy"))
    b = G.perturb(rows, 0.05, 4, kind="uniform").select("pair", "id", r6(F.col("x")).alias("ux"), r6(F.col("y")).alias("uy"))
    return a.join(b, ["pair", "id"])


def _covered(src, keys, res=RES):
    """Cells within 1.5 cell sizes of px, py: columns of cells first, then the chord of the circle in each."""
    def span(at, half, origin, step):
        return f"range(greatest(ceil(({at} - {half} - {origin})/{step}), 0)::INT, least(floor(({at} + {half} - {origin})/{step}), {res - 1})::INT + 1)"
    across = f"SELECT {keys}, px, py, gx, gy, dx, dy, 1.5*(dx+dy)/2 AS r FROM {src}"
    column = f"SELECT {keys}, gx, gy, dx, dy, r, px, py, unnest({span('px', 'r', 'gx', 'dx')}) AS i FROM ({across})"
    chord = f"SELECT {keys}, i::INT AS ix, {span('py', 'h', 'gy', 'dy')} AS js FROM (SELECT *, sqrt(greatest(r**2 - (gx + i*dx - px)**2, 0)) AS h FROM ({column}))"
    return f"SELECT {keys}, ix, unnest(js)::INT AS iy FROM ({chord})"


@query("jon_07", f"WITH {GRID}, q AS (SELECT gr.*, x AS px, y AS py FROM pp JOIN gr USING (pair)) SELECT DISTINCT pair, ix, iy FROM ({_covered('q', 'pair')})")
def covered(spark, d):
    p = _points(spark, d)
    rows = p.join(G.grid(p, RES, 0.05), "pair")
    return G.covered_cells(rows, ["pair"], RES).distinct()


def _hits(src):
    """Per cell and run the noise draws (at most 128) that occupy it, as bits of two words."""
    words = ", ".join(f"bit_or(CASE WHEN m // 64 = {k} THEN 1::UBIGINT << (m % 64)::UBIGINT ELSE 0 END) AS w{k}" for k in (0, 1))
    return f"""(SELECT pair, (code // 1000000 // {RES})::INT AS ix, (code // 1000000 % {RES})::INT AS iy, code % 1000000 AS b, (bit_count(w0) + bit_count(w1))::BIGINT AS hits FROM (
SELECT pair, (ix*{RES} + iy)::BIGINT*1000000 + b AS code, {words} FROM ({_covered(src, 'pair, b, m')}) GROUP BY pair, code))"""


_MC_ROWS = _mix(_mix(_mix("(SELECT *, 1 AS b FROM " + _keyed("pp", 4) + f" JOIN gr USING (pair), range(1, {MC + 1}) v(m))", "b"), "0"), "m")
_MC = f"""mh AS {_hits(_moved(_MC_ROWS))}, gp AS (SELECT cl.*, 1 - coalesce(hits, 0)/{MC} AS probability FROM cl LEFT JOIN mh USING (pair, ix, iy))"""


def _mc(spark, d, pcs=_PAIRS):
    p = _points(spark, d, pcs)
    g = G.grid(p, RES, 0.05)
    return p, g, G.cells(g, RES), G.monte_carlo_counts(p, g, RES, MC, 0.05, 4)


@query("agg_18", f"WITH {GRID}, {_MC} SELECT pair, ix, iy, R6(probability) AS probability FROM gp")
def occupancy_counts(spark, d):
    _, _, c, counts = _mc(spark, d)
    return G.gap_probability(c, counts, MC).select("pair", "ix", "iy", r6(F.col("probability")).alias("probability"))


@query("res_20", f"""WITH {GRID}, b AS (SELECT pair, count(*) AS n, 1.06*least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))/1.34)*pow(count(*), -0.2) AS hx,
1.06*least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))/1.34)*pow(count(*), -0.2) AS hy FROM pp GROUP BY pair),
z AS (SELECT cl.pair, ix, iy, sum(exp(-0.5*((pp.x - cl.x)/hx)**2 - 0.5*((pp.y - cl.y)/hy)**2))/(max(n)*max(hx)*max(hy)*2*pi()) AS z FROM cl JOIN pp USING (pair) JOIN b USING (pair) GROUP BY cl.pair, ix, iy)
SELECT pair, ix, iy FROM z WHERE z > 0.5""")
def dense_cells(spark, d):
    p = _points(spark, d)
    return G.kde_cells(p, ["pair"], G.grid(p, RES, 0.05), RES, 0.5)


_STEPS = ", ".join(f"{s!r}::DOUBLE" for s in DR.poisson_steps(1.0))
_RUNS = _mix(f"(SELECT *, b::BIGINT AS run FROM {_keyed('pp', 4)} JOIN gr USING (pair), range(1, {BOOTS + 1}) v(b))", "b")
_DRAWN = f"(SELECT * FROM (SELECT *, unnest(range(0, len(list_filter([{_STEPS}], lambda s: s <= h/4294967296.0::DOUBLE)))) AS k FROM {_RUNS}))"
_NOISE = _mix(f"(SELECT * FROM {_mix(_DRAWN, 'k')}, range(1, {MC + 1}) u(m))", "m")
_BOOT = f"""bh AS MATERIALIZED {_hits(_moved(_NOISE))},
bg AS (SELECT cl.*, 1 - coalesce(h, 0)/{MC * BOOTS} AS probability, 1 - coalesce(f, 0)/{BOOTS} AS stability FROM cl LEFT JOIN (SELECT pair, ix, iy, sum(hits) AS h,
count(*) FILTER (1 - hits/{MC} <= 0.5) AS f FROM bh GROUP BY pair, ix, iy) USING (pair, ix, iy))"""
GRID1 = _grid(ONE)


def _boot(spark, d):
    p = _points(spark, d, ("PC1", "PC2"))
    g = G.grid(p, RES, 0.05)
    return p, g, G.cells(g, RES), G.bootstrap_counts(p, g, RES, BOOTS, MC, 0.05, 4)


@query("res_21", f"WITH {GRID1}, {_BOOT} SELECT pair, ix, iy, R6(probability) AS probability FROM bg")
def bootstrap_probability(spark, d):
    _, _, c, counts = _boot(spark, d)
    return G.gap_probability(c, counts, MC * BOOTS).select("pair", "ix", "iy", r6(F.col("probability")).alias("probability"))


@query("res_22", f"WITH {GRID1}, {_BOOT} SELECT pair, ix, iy, R6(stability) AS stability FROM bg")
def gap_stability(spark, d):
    _, _, c, counts = _boot(spark, d)
    return G.gap_stability(c, counts, BOOTS).select("pair", "ix", "iy", r6(F.col("stability")).alias("stability"))


@query("res_23", f"WITH {GRID1}, {_MC}, {_BOOT} SELECT pair, ix, iy, R6(gp.probability*stability) AS certainty FROM gp JOIN bg USING (pair, ix, iy)")
def two_stage(spark, d):
    _, _, c, counts = _mc(spark, d, ("PC1", "PC2"))
    t = G.two_stage(G.gap_probability(c, counts, MC), G.gap_stability(c, _boot(spark, d)[3], BOOTS))
    return t.select("pair", "ix", "iy", r6(F.col("certainty")).alias("certainty"))


# horizontal runs of cells are the nodes: a run meets the runs of the next line that overlap it
_LABELS = """rw AS MATERIALIZED (SELECT pair, threshold, iy, min(ix) AS x0, max(ix) AS x1, min(node) AS node FROM (
SELECT *, ix - row_number() OVER (PARTITION BY pair, threshold, iy ORDER BY ix) AS island FROM gc) GROUP BY pair, threshold, iy, island),
nb AS MATERIALIZED (SELECT a.pair, a.threshold, a.node AS u, b.node AS v FROM rw a JOIN rw b ON a.pair = b.pair AND a.threshold = b.threshold AND b.iy = a.iy + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
sy2 AS MATERIALIZED (SELECT * FROM nb UNION ALL SELECT pair, threshold, v, u FROM nb),
rc AS (SELECT pair, threshold, node, node AS low FROM rw UNION SELECT sy2.pair, sy2.threshold, sy2.v, rc.low FROM rc JOIN sy2 ON sy2.pair = rc.pair AND sy2.threshold = rc.threshold AND sy2.u = rc.node),
lw AS (SELECT pair, threshold, node, min(low) AS low FROM rc GROUP BY pair, threshold, node),
rg AS (SELECT gc.*, dense_rank() OVER (PARTITION BY gc.pair, gc.threshold ORDER BY lw.low)::INT AS gap_id FROM gc JOIN rw ON rw.pair = gc.pair AND rw.threshold = gc.threshold AND rw.iy = gc.iy
AND gc.ix BETWEEN rw.x0 AND rw.x1 JOIN lw ON lw.pair = gc.pair AND lw.threshold = gc.threshold AND lw.node = rw.node)"""
_METRICS = """rm AS (SELECT pair, threshold, gap_id, count(*) AS n_cells, count(*)*max(dx*dy) AS area, avg(certainty) AS mean_certainty, max(certainty) AS max_certainty, avg(x) AS centroid_x, avg(y) AS centroid_y
FROM rg JOIN gr USING (pair) GROUP BY pair, threshold, gap_id),
su AS (SELECT rm.*, (SELECT min(sqrt((pp.x - rm.centroid_x)**2 + (pp.y - rm.centroid_y)**2)) FROM pp WHERE pp.pair = rm.pair) AS gap_depth FROM rm)"""
_TH = ", ".join(map(str, THRESHOLDS))
_MODELS = f"""WITH RECURSIVE {GRID1}, {_BOOT},
gc AS MATERIALIZED (SELECT pair, t AS threshold, ix, iy, x, y, probability AS certainty, iy*{RES} + ix AS node FROM bg, (SELECT unnest([{_TH}])::DOUBLE AS t) WHERE probability >= t),
{_LABELS}, {_METRICS}"""


def _certain(spark, d):
    p, g, c, counts = _boot(spark, d)
    return p, g, G.gap_probability(c, counts, MC * BOOTS).withColumn("certainty", F.col("probability"))


@query("res_24", f"{_MODELS} SELECT pair, threshold, gap_id, ix, iy, R6(certainty) AS certainty FROM rg")
def regions(spark, d):
    _, _, c = _certain(spark, d)
    r = G.label_regions(c, THRESHOLDS)
    return r.select("pair", "threshold", "gap_id", "ix", "iy", r6(F.col("certainty")).alias("certainty"))


@query("res_25", f"WITH {GRID1}, {_BOOT} SELECT pair, ix, iy, R6(x) AS x, R6(y) AS y, R6(probability) AS certainty, R6(1 - probability) AS elevation FROM bg")
def relief(spark, d):
    r = G.relief(_certain(spark, d)[2])
    return r.select("pair", "ix", "iy", *[r6(F.col(c)).alias(c) for c in ("x", "y", "certainty", "elevation")])


_SUMCOLS = ("area", "mean_certainty", "max_certainty", "centroid_x", "centroid_y", "gap_depth")


def _summary(spark, d):
    p, g, c = _certain(spark, d)
    return G.summary(G.region_metrics(G.label_regions(c, THRESHOLDS), g, p))


@query("res_26", f"{_MODELS} SELECT pair AS pc_pair, split_part(pair, '-', 1) AS pc_x, split_part(pair, '-', 2) AS pc_y, threshold, gap_id, n_cells, "
       + ", ".join(f"R6({c}) AS {c}" for c in _SUMCOLS) + " FROM su")
def gap_summary(spark, d):
    s = _summary(spark, d)
    return s.select("pc_pair", "pc_x", "pc_y", "threshold", "gap_id", "n_cells", *[r6(F.col(c)).alias(c) for c in _SUMCOLS])


@query("srt_08", f"{_MODELS} SELECT pair AS pc_pair, threshold, gap_id, R6(area) AS area FROM su ORDER BY su.area DESC, pair, threshold, gap_id LIMIT 5")
def largest_gaps(spark, d):
    return G.top_gaps(_summary(spark, d)).select("pc_pair", "threshold", "gap_id", r6(F.col("area")).alias("area"))


@query("res_27", f"SELECT s::VARCHAR AS asked, CASE WHEN s <= 1 THEN floor({N}*s) ELSE least(floor(s), {N}) END::BIGINT AS size FROM (SELECT unnest([0.5, 1.0, 30.0, 1e9])::DOUBLE AS s)")
def boot_sizes(spark, d):
    n = X.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    out = None
    for s, name in ((0.5, "0.5"), (1.0, "1.0"), (30.0, "30.0"), (1e9, "1000000000.0")):
        r = n.select(F.lit(name).alias("asked"), R.boot_size(F.col("n"), s).alias("size"))
        out = r if out is None else out.unionByName(r)
    return out


@query("res_15")
def detected(spark, d):
    r = G.detect_gaps(X.scores(spark, d, 3), ["PC1", "PC2", "PC3"], group="group", seed=9)
    s = r["summary"]
    return s.select("pc_pair", "threshold", "gap_id", "n_cells", *[r6(F.col(c)).alias(c) for c in _SUMCOLS])
