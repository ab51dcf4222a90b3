"""Queries over outline functions: ids fun_*, win_* and part of agg_*, jon_*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import base as B
from ..functions import outline as O
from ..functions.base import PI, let, pt, r6
from .registry import query



def long(df, coo, *keep):
    """``id, seq, x, y`` of an outline expression, rounded."""
    keep = keep or ("id",)
    return df.select(*keep, F.posexplode(coo).alias("s", "p")).select(
        *keep, (F.col("s") + 1).cast("int").alias("seq"),
        r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


def values(df, arr, name="v"):
    return df.select("id", F.posexplode(arr).alias("s", "p")).select(
        "id", (F.col("s") + 1).cast("int").alias("seq"), r6(F.col("p")).alias(name))


def coo_query(name, fn, sql):
    """Register an outline -> outline function."""
    query(name, sql)(lambda spark, d: long(X.landmarks(X.outlines(spark, d)), fn(F.col("coo"))))


def arr_query(name, fn, sql):
    query(name, sql)(lambda spark, d: values(X.outlines(spark, d), fn(F.col("coo"))))


def row_query(name, cols, sql):
    """Register scalar functions: ``{column: Column builder}``."""
    query(name, sql)(lambda spark, d: X.outlines(spark, d).select(
        "id", *[fn(F.col("coo")).alias(k) for k, fn in cols.items()]))


XY = "id, seq, R6(x) AS x, R6(y) AS y"

# ---- position and size -----------------------------------------------------

coo_query("fun_01", O.center, f"WITH @ctr SELECT {XY} FROM ctr")
row_query("fun_02", {"cx": lambda c: r6(O.centroid(c)["x"]), "cy": lambda c: r6(O.centroid(c)["y"])},
          "WITH @cen SELECT id, R6(mx) AS cx, R6(my) AS cy FROM cen")
row_query("fun_03", {"size": lambda c: r6(O.centroid_size(c))},
          "WITH @ctr SELECT id, R6(sqrt(avg(x*x + y*y))) AS size FROM ctr GROUP BY id")
arr_query("fun_04", O.centroid_dist, "WITH @ctr SELECT id, seq, R6(sqrt(x*x + y*y)) AS v FROM ctr")
coo_query("fun_05", O.scale, """WITH @ctr, cs AS (SELECT id, sqrt(avg(x*x + y*y)) AS k FROM ctr GROUP BY id)
SELECT id, seq, R6(x/k + mx) AS x, R6(y/k + my) AS y FROM ctr JOIN cs USING (id)""")
coo_query("fun_06", lambda c: O.scale_y(O.scale_x(c, 2.0), 0.5),
          "WITH @pts SELECT id, seq, R6(2*x) AS x, R6(y/2) AS y FROM pts")
coo_query("fun_07", O.template, """WITH @pts, b AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0,
max(y) AS y1 FROM pts GROUP BY id), k AS (SELECT *, least(1/(x1-x0), 1/(y1-y0)) AS k FROM b)
SELECT id, seq, R6(k*x + k*((x1-x0)/2 - x1)) AS x, R6(k*y + k*((y1-y0)/2 - y1)) AS y FROM pts JOIN k USING (id)""")


@query("fun_08", """WITH @pts, b AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
FROM pts GROUP BY id), r AS (SELECT *, (x1-x0)*(y1-y0) / (SELECT max((x1-x0)*(y1-y0)) FROM b) AS s FROM b),
k AS (SELECT *, least(s/(x1-x0), s/(y1-y0)) AS k FROM r)
SELECT id, seq, R6(k*x + k*((x1-x0)/2 - x1)) AS x, R6(k*y + k*((y1-y0)/2 - y1)) AS y FROM pts JOIN k USING (id)""")
def relative_template(spark, d):
    from ..operators.shapes import template_relatively
    return long(template_relatively(X.outlines(spark, d)), F.col("coo"))


coo_query("fun_09", lambda c: O.rotate_about(O.rotate(c, PI / 6), PI / 4, 1.0, 0.5), """WITH @pts,
r AS (SELECT id, seq, x*cos(pi()/6) - y*sin(pi()/6) AS x, x*sin(pi()/6) + y*cos(pi()/6) AS y FROM pts)
SELECT id, seq, R6((x-1)*cos(pi()/4) - (y-0.5)*sin(pi()/4) + 1) AS x,
R6((x-1)*sin(pi()/4) + (y-0.5)*cos(pi()/4) + 0.5) AS y FROM r""")
coo_query("fun_10", lambda c: O.untilt(c, 9), """WITH @ctr, a AS (SELECT id,
atan2(-y*x, x*x) AS t FROM ctr WHERE seq = 9)
SELECT id, seq, R6(x*cos(t) - y*sin(t) + mx) AS x, R6(x*sin(t) + y*cos(t) + my) AS y FROM ctr JOIN a USING (id)""")


@query("fun_11", """WITH @axes, r AS (SELECT id, seq, x*ux + y*uy AS x, x*vx + y*vy AS y FROM pts JOIN axes USING (id))
SELECT id, seq, R6(x) AS x, R6(y) AS y, R6(y - avg(y) OVER (PARTITION BY id)) AS y0 FROM r""")
def aligned(spark, d):
    o = X.outlines(spark, d).select("id", F.arrays_zip(
        O.align(F.col("coo")).alias("a"), O.align_x(F.col("coo")).alias("b")).alias("z"))
    return o.select("id", F.posexplode("z").alias("s", "z")).select(
        "id", (F.col("s") + 1).cast("int").alias("seq"), r6(F.col("z.a.x")).alias("x"),
        r6(F.col("z.a.y")).alias("y"), r6(F.col("z.b.y")).alias("y0"))


coo_query("fun_13", O.align_min_radius, """WITH @ctr, r AS (SELECT id, seq AS s0, mx, my,
row_number() OVER (PARTITION BY id ORDER BY x*x + y*y, seq) AS rn FROM ctr),
f AS (SELECT r.id, s0, atan2(p.y, p.x) AS t FROM r JOIN pts p ON p.id = r.id AND p.seq = s0 WHERE rn = 1)
SELECT p.id, (((seq - s0) % 64 + 64) % 64 + 1)::INT AS seq, R6(x*cos(-t) - y*sin(-t)) AS x,
R6(x*sin(-t) + y*cos(-t)) AS y FROM pts p JOIN f ON p.id = f.id""")
coo_query("fun_14", lambda c: O.translate(c, 1.0, -2.0),
          "WITH @pts SELECT id, seq, R6(x + 1) AS x, R6(y - 2) AS y FROM pts")
coo_query("fun_15", lambda c: O.shear_y(O.shear_x(c, 0.5), 0.25), """WITH @pts
SELECT id, seq, R6(x + 0.25*(y + 0.5*x)) AS x, R6(y + 0.5*x) AS y FROM pts""")
coo_query("fun_16", lambda c: O.flip_y(O.flip_x(c)), "WITH @pts SELECT id, seq, R6(-x) AS x, R6(-y) AS y FROM pts")
coo_query("fun_17", lambda c: O.bookstein(c, F.element_at("ldk", 1), F.element_at("ldk", 3)), """WITH @pts,
l AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x - a.x AS ux, b.y - a.y AS uy FROM pts a JOIN pts b
ON a.id = b.id AND a.seq = 1 + a.id % 8 AND b.seq = 33)
SELECT id, seq, R6((ux*(x-ax) + uy*(y-ay))/(ux*ux+uy*uy) - 0.5) AS x,
R6((ux*(y-ay) - uy*(x-ax))/(ux*ux+uy*uy)) AS y FROM pts JOIN l USING (id)""")
coo_query("fun_18", lambda c: O.baseline(c, F.element_at("ldk", 1), F.element_at("ldk", 3), (0.0, 0.0), (1.0, 1.0)),
          """WITH @pts, l AS (SELECT a.id, a.x AS ax, a.y AS ay, sqrt((b.x-a.x)**2 + (b.y-a.y)**2)/sqrt(2.0) AS r,
pi()/4 - atan2(b.y-a.y, b.x-a.x) AS t FROM pts a JOIN pts b ON a.id = b.id AND a.seq = 1 + a.id % 8 AND b.seq = 33)
SELECT id, seq, R6(((x-ax)*cos(t) - (y-ay)*sin(t))/r) AS x, R6(((x-ax)*sin(t) + (y-ay)*cos(t))/r) AS y
FROM pts JOIN l USING (id)""")


@query("fun_19", """WITH @pts SELECT id, seq,
R6(x + 0.04*concat('0x', substr(md5(concat_ws(':', 7, id, seq, 'x')), 1, 8))::BIGINT/4294967296.0 - 0.02) AS x,
R6(y + 0.04*concat('0x', substr(md5(concat_ws(':', 7, id, seq, 'y')), 1, 8))::BIGINT/4294967296.0 - 0.02) AS y FROM pts""")
def jittered(spark, d):
    from ..operators.shapes import jitter
    return long(jitter(X.outlines(spark, d), 0.02, seed=7), F.col("coo"))


@query("fun_20", """WITH @ctr, h AS (SELECT 'up' AS side, * FROM ctr WHERE y >= 0 UNION ALL SELECT 'down', * FROM ctr WHERE y <= 0
UNION ALL SELECT 'right', * FROM ctr WHERE x >= 0 UNION ALL SELECT 'left', * FROM ctr WHERE x <= 0)
SELECT id, side, row_number() OVER (PARTITION BY id, side ORDER BY seq)::INT AS seq, R6(x) AS x, R6(y) AS y FROM h""")
def halves(spark, d):
    o = X.outlines(spark, d).select("id", F.explode(let(O.center(F.col("coo")), lambda c: F.array(*[
        F.struct(F.lit(s).alias("side"), O.half(c, s).alias("coo")) for s in ("up", "down", "left", "right")]))).alias("h"))
    return long(o.select("id", "h.side", "h.coo"), F.col("coo"), "id", "side")


def _ray_sql(angle):
    return f"""SELECT id, {angle} AS angle, arg_min(seq, (d, seq)) AS idx FROM (SELECT p.id, p.seq,
(p.x - f.t*cos({angle}))**2 + (p.y - f.t*sin({angle}))**2 AS d FROM ctr p JOIN (
SELECT id, max(t) AS t FROM (SELECT id, (x*ey - y*ex)/(cos({angle})*ey - sin({angle})*ex) AS t,
(x*sin({angle}) - y*cos({angle}))/(cos({angle})*ey - sin({angle})*ex) AS s FROM edg) WHERE t >= 0 AND s >= 0 AND s <= 1
GROUP BY id) f USING (id)) GROUP BY id"""


@query("fun_21", f"""WITH @ctr, edg AS (SELECT p.id, p.x, p.y, q.x - p.x AS ex, q.y - p.y AS ey FROM ctr p JOIN ctr q
ON p.id = q.id AND q.seq = p.seq % 64 + 1)
SELECT id, R6(angle::DOUBLE) AS angle, idx::INT AS idx, idx::INT AS seg_idx FROM ({_ray_sql('0.3')} UNION ALL {_ray_sql('2.0')})""")
def rays(spark, d):
    o = X.outlines(spark, d)
    far = 10.0
    import math
    return o.select("id", F.explode(F.array(*[F.struct(
        r6(F.lit(a)).alias("angle"), O.ray_index(F.col("coo"), a).alias("idx"),
        O.segment_index(F.col("coo"), 0.0, 0.0, far * math.cos(a), far * math.sin(a)).alias("seg_idx"))
        for a in (0.3, 2.0)])).alias("r")).select("id", "r.*")


coo_query("fun_22", lambda c: let(c, lambda p: F.zip_with(p, O.with_next(p), lambda a, b: O.interpolate_between(a, b, 0.25))),
          """WITH @pts SELECT p.id, p.seq, R6(p.x + 0.25*(q.x-p.x)) AS x, R6(p.y + 0.25*(q.y-p.y)) AS y
FROM pts p JOIN pts q ON p.id = q.id AND q.seq = p.seq % 64 + 1""")


@query("fun_23", """WITH @pts SELECT id, seq, R6(sqrt(x*x+y*y)) AS modulus, R6(atan2(y,x)) AS argument, R6(x) AS x, R6(y) AS y FROM pts""")
def polar(spark, d):
    o = X.outlines(spark, d).select("id", let(O.to_polar(F.col("coo")), lambda q: B.zip_named(
        q=q, p=O.from_polar(q))).alias("z"))
    o = o.select("id", F.posexplode("z").alias("s", "z"))
    q, p = F.col("z.q"), F.col("z.p")
    return o.select("id", (F.col("s") + 1).cast("int").alias("seq"), r6(q["mod"]).alias("modulus"),
                    r6(q["arg"]).alias("argument"), r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


_LW = """lw AS (SELECT id, max(x*ux+y*uy) - min(x*ux+y*uy) AS l, max(x*vx+y*vy) - min(x*vx+y*vy) AS w
FROM pts JOIN axes USING (id) GROUP BY id)"""
_AR = """ar AS (SELECT p.id, abs(sum(p.x*q.y - q.x*p.y))/2 AS a FROM pts p JOIN pts q
ON p.id = q.id AND q.seq = p.seq % 64 + 1 GROUP BY p.id)"""
_PE = "pe AS (SELECT id, sum(d) AS p FROM stp WHERE seq > 1 GROUP BY id)"

row_query("fun_24", {"length": lambda c: r6(O.length_width(c)["length"]), "width": lambda c: r6(O.length_width(c)["width"])},
          f"WITH @axes, {_LW} SELECT id, R6(l) AS length, R6(w) AS width FROM lw")
row_query("fun_25", {k: (lambda c, k=k: r6(O.bounding_box(c)[k])) for k in ("x0", "x1", "y0", "y1")},
          """WITH @pts SELECT id, R6(min(x)) AS x0, R6(max(x)) AS x1, R6(min(y)) AS y0, R6(max(y)) AS y1
FROM pts GROUP BY id""")
row_query("fun_26", {"area": lambda c: r6(O.area(c))}, f"WITH @pts, {_AR} SELECT id, R6(a) AS area FROM ar")
row_query("fun_27", {"perim": lambda c: r6(O.perimeter(c))}, f"WITH @stp, {_PE} SELECT id, R6(p) AS perim FROM pe")
row_query("fun_28", {"circularity": lambda c: r6(O.circularity(c)), "haralick": lambda c: r6(O.circularity_haralick(c)),
                     "norm": lambda c: r6(O.circularity_norm(c))},
          f"""WITH @ctr, @stp, {_PE}, {_AR}, hk AS (SELECT id, avg(sqrt(x*x+y*y))/stddev_samp(sqrt(x*x+y*y)) AS h
FROM ctr GROUP BY id) SELECT id, R6(p*p/a) AS circularity, R6(h) AS haralick, R6(p*p/(4*pi()*a)) AS norm
FROM pe JOIN ar USING (id) JOIN hk USING (id)""")
row_query("fun_29", {"eigen": lambda c: r6(O.eccentricity_eigen(c)), "box": lambda c: r6(O.eccentricity_box(c))},
          f"WITH @axes, {_LW} SELECT id, R6(l2/l1) AS eigen, R6(w/l) AS box FROM lw JOIN axes USING (id)")
row_query("fun_30", {"elongation": lambda c: r6(O.elongation(c)), "rectangularity": lambda c: r6(O.rectangularity(c))},
          f"""WITH @axes, {_LW}, {_AR} SELECT id, R6(1 - w/l) AS elongation, R6(a/(l*w)) AS rectangularity
FROM lw JOIN ar USING (id)""")

_ANG = """ang AS (SELECT p.id, p.seq, p.label, atan2((q.x-p.x)*(r.y-p.y) - (q.y-p.y)*(r.x-p.x),
(q.x-p.x)*(r.x-p.x) + (q.y-p.y)*(r.y-p.y)) AS t, sqrt((r.x-p.x)**2 + (r.y-p.y)**2) AS l FROM pts p
JOIN pts q ON q.id = p.id AND q.seq = CASE WHEN p.seq = 1 THEN 64 ELSE p.seq - 1 END
JOIN pts r ON r.id = p.id AND r.seq = p.seq % 64 + 1)"""
_RECT = """rl AS (SELECT id, 4/(4-pi())*(max(sum_l)/min(p) - pi()/4) AS rect FROM (
SELECT c.id, c.alpha, sum(l) AS sum_l, sum(l*(abs(cos(t+alpha)) + abs(sin(t+alpha)))) AS p FROM ang e JOIN (
SELECT id, seq, k, abs(t - k*pi()/2) AS alpha FROM ang, range(1, 5) r(k)) c USING (id)
GROUP BY c.id, c.seq, c.k, c.alpha) GROUP BY id)"""
@query("fun_32", f"WITH @pts, {_ANG}, {_RECT} SELECT id, R6(rect) AS rectilinearity FROM rl")
def rectilinearity(spark, d):
    o = O.with_rectilinearity(X.outlines(spark, d), F.col("coo"))
    return o.select("id", r6(F.col("rectilinearity")).alias("rectilinearity"))


@query("fun_34", """WITH @scores, m AS (SELECT min("PC1") AS lo, max("PC1" - (SELECT min("PC1") FROM scores)) AS span FROM scores)
SELECT "ID", R6(("PC1" - lo)/span) AS v FROM scores, m""")
def normalised(spark, d):
    from ..operators.tables import min_max
    return min_max(X.scores(spark, d), "PC1", "v").select("ID", r6(F.col("v")).alias("v"))


@query("fun_35", """WITH @scores, m AS (SELECT min("PC1") AS lo, max("PC1") - min("PC1") AS span FROM scores)
SELECT "ID", least(floor(("PC1" - lo)/span*1000) + 1, 1000)::BIGINT AS bin FROM scores, m""")
def colour_bins(spark, d):
    from ..operators.tables import colour_bin
    return colour_bin(X.scores(spark, d), "PC1", 1000).select("ID", "bin")


# ---- ordered operators -------------------------------------------------------

arr_query("win_01", O.cumulative_perimeter,
          "WITH @stp SELECT id, seq, R6(sum(coalesce(d, 0)) OVER (PARTITION BY id ORDER BY seq)) AS v FROM stp")
arr_query("win_02", O.steps, "WITH @stp SELECT id, (seq - 1)::INT AS seq, R6(d) AS v FROM stp WHERE seq > 1")


@query("win_03", f"WITH @pts, {_ANG} SELECT id, seq, R6(t) AS v, R6(abs(t)) AS acos FROM ang")
def vertex_angles(spark, d):
    z = F.arrays_zip(O.edge_angles(F.col("coo")).alias("a"), O.edge_angles(F.col("coo"), "acos").alias("b"))
    o = X.outlines(spark, d).select("id", F.posexplode(z).alias("s", "z"))
    return o.select("id", (F.col("s") + 1).cast("int").alias("seq"), r6(F.col("z.a")).alias("v"),
                    r6(F.col("z.b")).alias("acos"))


arr_query("win_04", O.tangent_angles, """WITH @wrap, a AS (SELECT id, seq, atan2(y-py, x-px) AS t FROM wrap),
u AS (SELECT a.id, a.seq, a.t - f.t - 2*pi()*(a.seq-1)/64 AS q FROM a JOIN a f ON f.id = a.id AND f.seq = 1)
SELECT id, seq, R6(q - floor(q/(2*pi()))*2*pi()) AS v FROM u""")


@query("win_05", """WITH @pts SELECT id, ((seq - 10 + 64) % 64 + 1)::INT AS seq, R6(x) AS x, R6(y) AS y,
CASE WHEN (1 + id % 8 - 10 + 64) % 64 = 0 THEN 1 ELSE (1 + id % 8 - 10 + 64) % 64 END::INT AS first_ldk FROM pts""")
def slid(spark, d):
    o = X.landmarks(X.outlines(spark, d)).select(
        "id", O.slide(F.col("coo"), 10).alias("moved"),
        F.element_at(O.slide_landmarks(F.col("ldk"), 10, F.size("coo")), 1).alias("first_ldk"))
    return long(o, F.col("moved"), "id", "first_ldk")


@query("win_06", """WITH @ctr, c AS (SELECT id, 'up' AS direction, seq, abs(x) AS d FROM ctr WHERE y > 0
UNION ALL SELECT id, 'down', seq, abs(x) FROM ctr WHERE y < 0 UNION ALL SELECT id, 'left', seq, abs(y) FROM ctr WHERE x < 0
UNION ALL SELECT id, 'right', seq, abs(y) FROM ctr WHERE x > 0),
f AS (SELECT id, direction, arg_min(seq, (d, seq)) AS s0 FROM c GROUP BY id, direction)
SELECT p.id, direction, ((seq - s0 + 64) % 64 + 1)::INT AS seq, R6(x) AS x, R6(y) AS y FROM pts p JOIN f ON p.id = f.id""")
def slid_to_direction(spark, d):
    o = X.outlines(spark, d).select("id", F.explode(F.array(*[F.struct(
        F.lit(s).alias("direction"), O.slide_direction(F.col("coo"), s).alias("coo"))
        for s in ("up", "down", "left", "right")])).alias("h")).select("id", "h.direction", "h.coo")
    return long(o, F.col("coo"), "id", "direction")


coo_query("win_07", lambda c: O.slide_gap(c, force=True), """WITH @stp, w AS (SELECT id, arg_max(seq, (d, -seq)) AS s0
FROM stp WHERE seq > 1 GROUP BY id)
SELECT p.id, ((p.seq - s0 + 64) % 64 + 1)::INT AS seq, R6(x) AS x, R6(y) AS y FROM pts p JOIN w ON p.id = w.id""")


def _smooth_sql(n):
    out = ["s0 AS (SELECT id, seq, x, y FROM pts)"]
    for i in range(n):
        out.append(f"""s{i + 1} AS (SELECT p.id, p.seq, p.x/2 + a.x/4 + b.x/4 AS x, p.y/2 + a.y/4 + b.y/4 AS y FROM s{i} p
JOIN s{i} a ON a.id = p.id AND a.seq = p.seq % 64 + 1
JOIN s{i} b ON b.id = p.id AND b.seq = CASE WHEN p.seq = 1 THEN 64 ELSE p.seq - 1 END)""")
    return ", ".join(out)


coo_query("win_08", lambda c: O.smooth(c, 3), f"WITH @pts, {_smooth_sql(3)} SELECT {XY} FROM s3")
# the updated predecessor makes every value a geometric series of the raw points
coo_query("win_09", lambda c: O.smooth_curve(c, 1), """WITH @pts, r AS (SELECT p.id, p.seq,
0.5*p.x + 0.25*q.x AS rx, 0.5*p.y + 0.25*q.y AS ry FROM pts p JOIN pts q ON q.id = p.id AND q.seq = p.seq + 1
WHERE p.seq BETWEEN 2 AND 63), s AS (SELECT r.id, r.seq, sum(k.rx*0.25**(r.seq - k.seq)) AS x,
sum(k.ry*0.25**(r.seq - k.seq)) AS y FROM r JOIN r k ON k.id = r.id AND k.seq <= r.seq GROUP BY r.id, r.seq)
SELECT s.id, s.seq, R6(s.x + f.x*0.25**(s.seq - 1)) AS x, R6(s.y + f.y*0.25**(s.seq - 1)) AS y FROM s JOIN pts f
ON f.id = s.id AND f.seq = 1 UNION ALL SELECT id, seq, R6(x), R6(y) FROM pts WHERE seq IN (1, 64)""")
_RESAMPLE = """cl AS (SELECT id, seq, x, y FROM pts UNION ALL SELECT id, 65, x, y FROM pts WHERE seq = 1),
cd AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cl WINDOW w AS (PARTITION BY id ORDER BY seq)),
ce AS (SELECT *, sqrt((nx-x)**2 + (ny-y)**2) AS d FROM cd WHERE seq < 65),
cf AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY seq) - d AS lo, sum(d) OVER (PARTITION BY id ORDER BY seq) AS hi,
sum(d) OVER (PARTITION BY id) AS total FROM ce)"""
@query("win_10", f"""WITH @pts, {_RESAMPLE}
SELECT id, (k + 1)::INT AS seq, R6(x + (total*k/100 - lo)/d*(nx-x)) AS x, R6(y + (total*k/100 - lo)/d*(ny-y)) AS y
FROM cf JOIN range(0, 100) t(k) ON total*k/100 >= lo AND total*k/100 < hi""")
def resampled(spark, d):
    return long(O.with_interpolated(X.outlines(spark, d), F.col("coo"), 100), F.col("resampled"))


@query("win_11", """WITH @pts, k AS (SELECT i, round_even(1 + i*63/24.0, 0)::INT AS s FROM range(0, 24) t(i))
SELECT id, (i + 1)::INT AS seq, R6(x) AS x, R6(y) AS y, ceil((1 + id % 8)*(24.0/64))::INT AS first_ldk FROM pts JOIN k ON seq = s""")
def subsampled(spark, d):
    o = X.landmarks(X.outlines(spark, d)).select(
        "id", O.sample_prop(F.col("coo"), 0.375).alias("sub"),
        F.element_at(O.sample_landmarks(F.col("ldk"), 24, F.size("coo")), 1).alias("first_ldk"))
    return long(o, F.col("sub"), "id", "first_ldk")


coo_query("win_12", lambda c: O.sample_angles(c, 16), """WITH @ctr, b AS (SELECT id, i, arg_max(seq, (c, -seq)) AS s FROM (
SELECT id, i, seq, cos(atan2(y, x) - 2*pi()*i/16) AS c FROM ctr, range(0, 16) t(i)) GROUP BY id, i)
SELECT b.id, row_number() OVER (PARTITION BY b.id ORDER BY s)::INT AS seq, R6(x) AS x, R6(y) AS y
FROM b JOIN ctr ON ctr.id = b.id AND ctr.seq = b.s""")


@query("win_13", """WITH @pts, l AS (SELECT id, i, s, coalesce(lead(s) OVER (PARTITION BY id ORDER BY s), 64) AS e FROM (
SELECT vec_id AS id, unnest([1 + vec_id % 8, 17, 33, 49]) AS s, unnest([1, 2, 3, 4]) AS i FROM embeddings))
SELECT l.id, i::INT AS run, (seq - s + 1)::INT AS seq, R6(x) AS x, R6(y) AS y FROM l JOIN pts p ON p.id = l.id AND p.seq BETWEEN s AND e""")
def sliced(spark, d):
    o = X.landmarks(X.outlines(spark, d)).select(
        "id", F.posexplode(O.slice_runs(F.col("coo"), F.col("ldk"))).alias("r", "coo")).select(
        "id", (F.col("r") + 1).cast("int").alias("run"), "coo")
    return long(o, F.col("coo"), "id", "run")


@query("win_14", """WITH @pts SELECT id, 'both' AS part, (seq - 3)::INT AS seq, R6(x) AS x, R6(y) AS y FROM pts WHERE seq BETWEEN 4 AND 61
UNION ALL SELECT id, 'top', (seq - 3)::INT, R6(x), R6(y) FROM pts WHERE seq > 3
UNION ALL SELECT id, 'bottom', seq, R6(x), R6(y) FROM pts WHERE seq <= 61""")
def trimmed(spark, d):
    o = X.outlines(spark, d).select("id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("part"), fn(F.col("coo"), 3).alias("coo"))
        for n, fn in (("both", O.trim), ("top", O.trim_top), ("bottom", O.trim_bottom))])).alias("h"))
    return long(o.select("id", "h.part", "h.coo"), F.col("coo"), "id", "part")


@query("win_15", """WITH @pts SELECT id, (65 - seq)::INT AS seq, R6(x) AS x, R6(y) AS y, (65 - (1 + id % 8))::INT AS first_ldk FROM pts""")
def reversed_order(spark, d):
    o = X.landmarks(X.outlines(spark, d)).select("id", O.reverse(F.col("coo")).alias("back"), F.element_at(
        O.reverse_landmarks(F.col("ldk"), F.size("coo")), 1).alias("first_ldk"))
    return long(o, F.col("back"), "id", "first_ldk")


coo_query("win_16", lambda c: O.extract(c, F.col("ldk")), """WITH @pts, l AS (SELECT vec_id AS id, unnest([1 + vec_id % 8, 17, 33, 49]) AS s,
unnest([1, 2, 3, 4]) AS i FROM embeddings) SELECT l.id, i::INT AS seq, R6(x) AS x, R6(y) AS y FROM l JOIN pts p ON p.id = l.id AND p.seq = l.s""")
row_query("win_17", {"clockwise": O.likely_clockwise, "anticlockwise": lambda c: ~O.likely_clockwise(c)},
          """WITH @pts, a AS (SELECT id, seq, atan2(y, x) - lag(atan2(y, x)) OVER (PARTITION BY id ORDER BY seq) AS d FROM pts)
SELECT id, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) < 0.5 AS clockwise, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS anticlockwise
FROM a WHERE seq > 1 GROUP BY id""")
row_query("win_18", {"sd": lambda c: r6(O.sd_of(O.radius_angles(c))), "equal": O.is_equally_spaced_radii},
          """WITH @ctr, a AS (SELECT p.id, acos((p.x*q.x + p.y*q.y)/(sqrt(p.x*p.x+p.y*p.y)*sqrt(q.x*q.x+q.y*q.y))) AS t
FROM ctr p JOIN ctr q ON q.id = p.id AND q.seq = p.seq % 64 + 1)
SELECT id, R6(stddev_samp(t)) AS sd, stddev_samp(t) < pi()/90 AS equal FROM a GROUP BY id""")
coo_query("win_19", O.displacement, """WITH @pts SELECT p.id, p.seq, R6(p.x - f.x) AS x, R6(p.y - f.y) AS y
FROM pts p JOIN pts f ON f.id = p.id AND f.seq = 1""")


@query("win_20", """WITH @pts, o AS (SELECT id, seq, x, y FROM pts WHERE seq <= 60),
e AS (SELECT a.id, a.x - z.x AS dx, a.y - z.y AS dy FROM o a JOIN o z ON a.id = z.id AND a.seq = 1 AND z.seq = 60),
s AS (SELECT id, seq, x + dx*(seq-1)/59 AS x2, y + dy*(seq-1)/59 AS y2, x, y FROM o JOIN e USING (id)),
m AS (SELECT id, avg(x) - avg(x2) AS ox, avg(y) - avg(y2) AS oy FROM s GROUP BY id)
SELECT id, seq, R6(x2 + ox) AS x, R6(y2 + oy) AS y, 61::INT AS closed_n, false AS was_closed, true AS is_closed,
60::INT AS reopened_n FROM s JOIN m USING (id)""")
def closing(spark, d):
    part = F.slice(F.col("coo"), 1, 60)
    o = X.outlines(spark, d).select("id", part.alias("coo")).select(
        "id", O.force_close(F.col("coo")).alias("forced"), F.size(O.close(F.col("coo"))).alias("closed_n"),
        O.is_closed(F.col("coo")).alias("was_closed"), O.is_closed(O.close(F.col("coo"))).alias("is_closed"),
        F.size(O.unclose(O.close(F.col("coo")))).alias("reopened_n"))
    return long(o, F.col("forced"), "id", "closed_n", "was_closed", "is_closed", "reopened_n")


_PIX = """pix AS (SELECT id, label, seq, CASE (id + seq*seq) % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 7 THEN 1 WHEN 2 THEN 0 WHEN 6 THEN 0 ELSE -1 END AS sx,
CASE (id + seq*seq) % 8 WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE -1 END AS sy, (id + seq*seq) % 8 AS code FROM pts)"""


@query("win_21", f"""WITH @pts, {_PIX} SELECT id, seq, (sum(sx) OVER (PARTITION BY id ORDER BY seq))::INT AS x,
(sum(sy) OVER (PARTITION BY id ORDER BY seq))::INT AS y, (CASE WHEN seq = 1 THEN NULL ELSE code END)::INT AS code FROM pix""")
def chain(spark, d):
    codes = F.transform(F.col("coo"), lambda p, i: ((F.col("id") + (i + 1) * (i + 1)) % 8).cast("int"))
    o = X.outlines(spark, d).select("id", O.chain_decode(codes).alias("pix"))
    o = o.select("id", F.posexplode(B.zip_named(pix=F.col("pix"), code=F.concat(
        F.array(F.lit(None).cast("int")), O.chain_code(F.col("pix"))))).alias("s", "z"))
    z = F.col("z")
    return o.select("id", (F.col("s") + 1).cast("int").alias("seq"), z["pix"]["x"].alias("x"),
                    z["pix"]["y"].alias("y"), z["code"].alias("code"))


# ---- set-level summaries of outlines ----------------------------------------

@query("agg_03", """WITH @ctr SELECT id, R6(max(mx)) AS cx, R6(max(my)) AS cy, R6(avg(sqrt(x*x+y*y))) AS mean_radius FROM ctr GROUP BY id""")
def radius_metadata(spark, d):
    return X.outlines(spark, d).select(
        "id", r6(O.centroid(F.col("coo"))["x"]).alias("cx"), r6(O.centroid(F.col("coo"))["y"]).alias("cy"),
        r6(let(O.centroid_dist(F.col("coo")), lambda v: B.fsum(v) / F.size(v))).alias("mean_radius"))


@query("agg_04", """WITH @pts, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
s AS (SELECT id, max(x)-min(x) AS dx, max(y)-min(y) AS dy FROM pts GROUP BY id)
SELECT id, R6(dx) AS dx, R6(dy) AS dy, R6(x0 - 0.1*(x1-x0)) AS x0, R6(x1 + 0.1*(x1-x0)) AS x1,
R6(y0 - 0.1*(y1-y0)) AS y0, R6(y1 + 0.1*(y1-y0)) AS y1 FROM s, r""")
def set_range(spark, d):
    from ..operators.shapes import set_range as rng
    o = X.outlines(spark, d)
    box = rng(o, enlarge=0.1)
    return o.select("id", r6(O.diff_range(F.col("coo"))["x"]).alias("dx"), r6(O.diff_range(F.col("coo"))["y"]).alias("dy"),
                    box.scalar().alias("b")).select("id", "dx", "dy", *[
                        r6(F.col("b")[k]).alias(k) for k in ("x0", "x1", "y0", "y1")])


row_query("agg_05", {"n": O.nb}, "WITH @pts SELECT id, count(*)::INT AS n FROM pts GROUP BY id")

# ---- joins inside an outline --------------------------------------------------


@query("jon_03", """WITH @pts, a AS (SELECT id, (i + 1)::INT AS seq, x*1.1 AS x, y*1.1 AS y FROM pts JOIN (
SELECT i, round_even(1 + i*63/16.0, 0)::INT AS s FROM range(0, 16) t(i)) ON seq = s)
SELECT id, seq, R6(min(d)) AS d, arg_min(s, (d, s))::INT AS pos FROM (SELECT a.id, a.seq, p.seq AS s,
sqrt((a.x-p.x)**2 + (a.y-p.y)**2) AS d FROM a JOIN pts p ON p.id = a.id) GROUP BY id, seq""")
def nearest_points(spark, d):
    other = O.scale_y(O.scale_x(O.sample(F.col("coo"), 16), 1.1), 1.1)
    o = O.with_nearest(X.outlines(spark, d), other, F.col("coo"))
    o = o.select("id", F.posexplode(B.zip_named(d=F.col("near.d"), i=F.col("near.i"))).alias("s", "n"))
    return o.select("id", (F.col("s") + 1).cast("int").alias("seq"), r6(F.col("n.d")).alias("d"), F.col("n.i").alias("pos"))


arr_query("jon_04", lambda c: O.matched_distance(c, O.center(c)), """WITH @ctr SELECT p.id, p.seq,
R6(sqrt((p.x-c.x)**2 + (p.y-c.y)**2)) AS v FROM pts p JOIN ctr c ON c.id = p.id AND c.seq = p.seq""")


@query("srt_01", """WITH @pts, d AS (SELECT a.id, a.seq AS i, b.seq AS j, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d
FROM pts a JOIN pts b ON a.id = b.id AND a.seq < b.seq)
SELECT id, R6(max(d)) AS length, arg_max(i, (d, -i, -j))::INT AS i, arg_max(j, (d, -i, -j))::INT AS j FROM d GROUP BY id""")
def callipers(spark, d):
    from ..operators.hull import with_hull
    return with_hull(X.outlines(spark, d)).select(
        "id", r6(F.col("caliper.length")).alias("length"), F.col("caliper.i").alias("i"), F.col("caliper.j").alias("j"))


@query("fun_12", """WITH @pts, d AS (SELECT a.id, a.seq AS i, b.seq AS j, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d
FROM pts a JOIN pts b ON a.id = b.id AND a.seq < b.seq),
c AS (SELECT id, arg_max(i, (d, -i, -j)) AS i, arg_max(j, (d, -i, -j)) AS j FROM d GROUP BY id),
l AS (SELECT c.id, a.x AS ax, a.y AS ay, b.x - a.x AS ux, b.y - a.y AS uy FROM c JOIN pts a ON a.id = c.id AND a.seq = i
JOIN pts b ON b.id = c.id AND b.seq = j)
SELECT id, seq, R6((ux*(x-ax) + uy*(y-ay))/(ux*ux+uy*uy) - 0.5) AS x, R6((ux*(y-ay) - uy*(x-ax))/(ux*ux+uy*uy)) AS y
FROM pts JOIN l USING (id)""")
def calliper_aligned(spark, d):
    from ..operators.hull import with_hull
    return long(with_hull(X.outlines(spark, d)), O.bookstein(F.col("coo"), F.col("caliper.i"), F.col("caliper.j")))


# hull vertices of one outline: no other vertex lies right of the edge to the next
_HULL1 = """he AS (SELECT p.id, p.seq AS i, q.seq AS j, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM pts p JOIN pts q
ON p.id = q.id AND p.seq <> q.seq WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.id = p.id AND r.seq <> p.seq AND r.seq <> q.seq
AND (q.x-p.x)*(r.y-p.y) - (q.y-p.y)*(r.x-p.x) < 0)),
hs AS (SELECT id, sum(ax*by_ - bx*ay)/2 AS ha, sum(sqrt((ax-bx)**2 + (ay-by_)**2)) AS hp_closed FROM he GROUP BY id),
hf AS (SELECT id, sum(e) AS hp FROM (SELECT id, i, sqrt((ax-bx)**2 + (ay-by_)**2) AS e, row_number() OVER (PARTITION BY id ORDER BY i) AS rn,
count(*) OVER (PARTITION BY id) AS m FROM he) WHERE rn < m GROUP BY id)"""


@query("fun_31", f"""WITH @stp, {_PE}, {_AR}, {_HULL1} SELECT id, R6(hp/p) AS convexity, R6(a/ha) AS solidity
FROM pe JOIN ar USING (id) JOIN hs USING (id) JOIN hf USING (id)""")
def hull_ratios(spark, d):
    from ..operators.hull import with_hull
    o = with_hull(X.outlines(spark, d))
    return o.select("id", r6(O.perimeter(O.extract(F.col("coo"), F.col("hull"))) / O.perimeter(F.col("coo"))).alias("convexity"),
                    r6(O.area(F.col("coo")) / O.area(O.extract(F.col("coo"), F.col("hull")))).alias("solidity"))


@query("fun_33", f"""WITH @ctr, @axes, @stp, {_PE}, {_AR}, {_LW}, {_HULL1}, {_ANG}, {_RECT},
hk AS (SELECT id, avg(sqrt(x*x+y*y))/stddev_samp(sqrt(x*x+y*y)) AS h, sqrt(avg(x*x+y*y)) AS cs FROM ctr GROUP BY id),
cal AS (SELECT a.id, max(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS c FROM pts a JOIN pts b ON a.id = b.id AND a.seq < b.seq GROUP BY a.id)
SELECT id, R6(a) AS area, R6(c) AS calliper, R6(cs) AS centsize, R6(p*p/a) AS circularity, R6(h) AS circularityharalick,
R6(p*p/(4*pi()*a)) AS circularitynorm, R6(hp/p) AS convexity, R6(w/l) AS eccentricityboundingbox, R6(l2/l1) AS eccentricityeigen,
R6(1 - w/l) AS elongation, R6(l) AS length, R6(p) AS perim, R6(a/(l*w)) AS rectangularity, R6(a/ha) AS solidity, R6(w) AS width,
R6(rect) AS rectilinearity FROM pe JOIN ar USING (id) JOIN lw USING (id) JOIN hs USING (id) JOIN hf USING (id) JOIN hk USING (id)
JOIN cal USING (id) JOIN axes USING (id) JOIN (SELECT id, min(rect) AS rect FROM rl GROUP BY id) USING (id)""")
def scalars(spark, d):
    from ..operators.shapes import descriptors
    df = descriptors(X.outlines(spark, d), rectilinearity=True)
    return df.select("id", *[r6(F.col(c)).alias(c) for c in df.columns if c not in ("id", "label")])
