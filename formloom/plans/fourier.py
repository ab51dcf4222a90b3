"""Queries efa_*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import efa as E
from ..functions.base import r6
from ..operators import fourier as FO
from .outline import long
from .registry import query


def harmonics(df, harm, *keep):
    """``id, h, a, b, c, d`` of a harmonic array, rounded."""
    keep = keep or ("id",)
    return df.select(*keep, F.posexplode(harm).alias("p", "m")).select(
        *keep, (F.col("p") + 1).cast("int").alias("h"), *[r6(F.col(f"m.{x}")).alias(x) for x in E.LETTERS])


HARM = "id, h, R6(a) AS a, R6(b) AS b, R6(c) AS c, R6(d) AS d"


@query("efa_01", f"WITH @ef, @ef0 SELECT {HARM}, R6(ao) AS ao, R6(co) AS co FROM ef JOIN ef0 USING (id)")
def forward(spark, d):
    o = E.with_forward(X.outlines(spark, d), 12)
    o = o.select("id", "ef.harm", r6(F.col("ef.ao")).alias("ao"), r6(F.col("ef.co")).alias("co"))
    return harmonics(o, "harm", "id", "ao", "co")


@query("efa_02", "WITH @coe SELECT id, letter, h, R6(value) AS value FROM coe")
def set_coefficients(spark, d):
    c = E.long_coefficients(E.efourier(X.outlines(spark, d), 12))
    return c.select("id", "letter", "h", r6(F.col("value")).alias("value"))


@query("efa_03", f"WITH @efn SELECT {HARM}, R6(size) AS size, R6(th) AS theta, R6(psi) AS psi FROM efn JOIN nrm USING (id)")
def normalised(spark, d):
    o = E.with_forward(X.outlines(spark, d), 12).select("id", E.normalise(F.col("ef")).alias("n")).select(
        "id", "n.harm", *[r6(F.col(f"n.{k}")).alias(k) for k in ("size", "theta", "psi")])
    return harmonics(o, "harm", "id", "size", "theta", "psi")


@query("efa_04", """WITH @ef, @ef0 SELECT ef.id, (k + 1)::INT AS seq,
R6(max(ao)/2 + sum(a*cos(2*pi()*h*k/60) + b*sin(2*pi()*h*k/60))) AS x,
R6(max(co)/2 + sum(c*cos(2*pi()*h*k/60) + d*sin(2*pi()*h*k/60))) AS y
FROM ef JOIN ef0 USING (id), range(0, 60) t(k) WHERE h <= 8 GROUP BY ef.id, k""")
def inverse(spark, d):
    ef = E.with_forward(X.outlines(spark, d), 12)
    return long(E.with_inverse(ef, F.col("ef.harm"), F.col("ef.ao"), F.col("ef.co"), 8, 60), F.col("shape"))


@query("efa_05", f"WITH @ef SELECT {HARM} FROM ef")
def denormalised(spark, d):
    return harmonics(E.with_forward(X.outlines(spark, d), 12), E.denormalise(E.normalise(F.col("ef")))["harm"])


@query("efa_06", "WITH @ef SELECT id, h, R6((a*a + b*b + c*c + d*d)/2) AS power FROM ef")
def power(spark, d):
    o = E.with_forward(X.outlines(spark, d), 12).select("id", F.posexplode(E.power(F.col("ef.harm"))).alias("p", "v"))
    return o.select("id", (F.col("p") + 1).cast("int").alias("h"), r6(F.col("v")).alias("power"))


_CUMPOW = """cp AS (SELECT id, label, h, 100*sum(pw) OVER (PARTITION BY id ORDER BY h)/sum(pw) OVER (PARTITION BY id) AS v
FROM (SELECT id, label, h, (a*a+b*b+c*c+d*d)/2 AS pw FROM {src} WHERE h > 1))"""


@query("efa_07", f"""WITH @ef, {_CUMPOW.format(src='ef')}, m AS (SELECT h, median(v) AS med FROM cp GROUP BY h)
SELECT t::DOUBLE AS threshold, min(h)::INT AS minh FROM (SELECT unnest([50.0, 80.0, 90.0, 99.0]) AS t) JOIN m ON med > t GROUP BY t""")
def power_calibration(spark, d):
    return FO.power_calibration(FO.power_profile(X.outlines(spark, d), 12), (50, 80, 90, 99))


@query("agg_16", f"WITH @ef, {_CUMPOW.format(src='ef')} SELECT h, R6(median(v)) AS med FROM cp GROUP BY h")
def median_profile(spark, d):
    return FO.power_profile(X.outlines(spark, d), 12).select("h", r6(F.col("med")).alias("med"))


@query("efa_07_label", f"WITH @efn, {_CUMPOW.format(src='efn')} SELECT label, h, R6(median(v)) AS med FROM cp GROUP BY label, h")
def label_profile(spark, d):
    """Centre, scale, start on the left, 12 normalised harmonics, median power per label."""
    o = X.outlines(spark, d).withColumn("coo", E.normalise_shape(F.col("coo"), "left"))
    return FO.power_profile(o, 12, keys=["label"], norm=True).select("label", "h", r6(F.col("med")).alias("med"))


# the start point and centring do not change a centred reconstruction's coefficients
@query("efa_08", """WITH @ctr, wrap AS (SELECT p.id, p.label, p.seq, p.x, p.y, q.x AS px, q.y AS py,
greatest(sqrt((p.x-q.x)**2 + (p.y-q.y)**2), 1e-10) AS t FROM ctr p JOIN ctr q
ON p.id = q.id AND q.seq = CASE WHEN p.seq = 1 THEN 64 ELSE p.seq - 1 END), """
       + """cum AS (SELECT *, sum(t) OVER (PARTITION BY id ORDER BY seq) AS t1,
  sum(t) OVER (PARTITION BY id) AS tt FROM wrap),
ef AS (SELECT id, h, max(tt)/(2*pi()**2*h*h) * sum((x-px)/t*(cos(2*pi()*h*t1/tt) - cos(2*pi()*h*(t1-t)/tt))) AS a,
  max(tt)/(2*pi()**2*h*h) * sum((x-px)/t*(sin(2*pi()*h*t1/tt) - sin(2*pi()*h*(t1-t)/tt))) AS b,
  max(tt)/(2*pi()**2*h*h) * sum((y-py)/t*(cos(2*pi()*h*t1/tt) - cos(2*pi()*h*(t1-t)/tt))) AS c,
  max(tt)/(2*pi()**2*h*h) * sum((y-py)/t*(sin(2*pi()*h*t1/tt) - sin(2*pi()*h*(t1-t)/tt))) AS d
  FROM cum, (SELECT r::INT AS h FROM range(1, 10) t(r)) GROUP BY id, h),
ef0 AS (SELECT id, 2*sum(x*t/tt) AS ao, 2*sum(y*t/tt) AS co FROM cum GROUP BY id)
SELECT ef.id, r::INT AS rank, (k + 1)::INT AS seq,
R6(max(ao)/2 + sum(a*cos(2*pi()*h*k/20) + b*sin(2*pi()*h*k/20))) AS x,
R6(max(co)/2 + sum(c*cos(2*pi()*h*k/20) + d*sin(2*pi()*h*k/20))) AS y
FROM ef JOIN ef0 USING (id), range(0, 20) t(k), range(1, 10) u(r) WHERE h <= r GROUP BY ef.id, k, r""")
def rank_reconstructions(spark, d):
    r = FO.reconstructions(X.outlines(spark, d), range(1, 10), nb_pts=20)
    return r.select("id", "rank", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


_DEV_RANKS = (2, 4, 8)


@query("efa_09", """WITH @ef, @ef0, cl AS (SELECT id, seq, x, y FROM pts UNION ALL SELECT id, 65, x, y FROM pts WHERE seq = 1),
cd AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cl WINDOW w AS (PARTITION BY id ORDER BY seq)),
ce AS (SELECT *, sqrt((nx-x)**2 + (ny-y)**2) AS d FROM cd WHERE seq < 65),
cf AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY seq) - d AS lo, sum(d) OVER (PARTITION BY id ORDER BY seq) AS hi,
sum(d) OVER (PARTITION BY id) AS total FROM ce),
best AS (SELECT id, x + (total*k/64 - lo)/d*(nx-x) AS x, y + (total*k/64 - lo)/d*(ny-y) AS y
FROM cf JOIN range(0, 64) t(k) ON total*k/64 >= lo AND total*k/64 < hi),
cs AS (SELECT p.id, sqrt(avg((p.x-c.mx)**2 + (p.y-c.my)**2)) AS size FROM pts p JOIN (SELECT id, avg(x) AS mx, avg(y) AS my
FROM pts GROUP BY id) c USING (id) GROUP BY p.id),
built AS (SELECT ef.id, r::INT AS rank, (k + 1)::INT AS pt, max(ao)/2 + sum(a*cos(2*pi()*h*k/40) + b*sin(2*pi()*h*k/40)) AS x,
max(co)/2 + sum(c*cos(2*pi()*h*k/40) + d*sin(2*pi()*h*k/40)) AS y
FROM ef JOIN ef0 USING (id), range(0, 40) t(k), (SELECT unnest([2, 4, 8]) AS r) WHERE h <= r GROUP BY ef.id, k, r),
dev AS (SELECT b.id, rank, pt, min(sqrt((b.x-e.x)**2 + (b.y-e.y)**2))/max(size) AS d FROM built b JOIN best e ON e.id = b.id
JOIN cs ON cs.id = b.id GROUP BY b.id, rank, pt)
SELECT rank, pt, R6(median(d)) AS med, R6(stddev_samp(d)) AS sd FROM dev GROUP BY rank, pt""")
def deviation_calibration(spark, d):
    r = FO.deviations(X.outlines(spark, d), _DEV_RANKS, nb_pts=40)
    return r.select("rank", "pt", r6(F.col("med")).alias("med"), r6(F.col("sd")).alias("sd"))


@query("efa_10", """WITH @coe, s AS (SELECT id, sum(CASE WHEN letter IN ('A','D') THEN abs(value) ELSE 0 END) AS ad,
sum(CASE WHEN letter IN ('B','C') THEN abs(value) ELSE 0 END) AS bc FROM coe GROUP BY id)
SELECT id, R6(ad) AS "AD", R6(bc) AS "BC", R6(ad + bc) AS amp, R6(ad/(ad + bc)) AS sym FROM s""")
def symmetry(spark, d):
    c = E.efourier(X.outlines(spark, d), 12).select("id", E.symmetry(F.col("coe")).alias("s"))
    return c.select("id", *[r6(F.col(f"s.{k}")).alias(k) for k in ("AD", "BC", "amp", "sym")])


@query("efa_11", """WITH @coe SELECT id, letter, h, R6(CASE WHEN letter IN ('B','C') THEN 0 ELSE value END) AS sym,
R6(CASE WHEN letter IN ('A','D') THEN 0 ELSE value END) AS asym FROM coe""")
def without_asymmetry(spark, d):
    c = E.efourier(X.outlines(spark, d), 12)
    harm = E.from_coe(F.col("coe"))
    out = []
    for name, fn in (("sym", E.remove_asymmetry), ("asym", E.remove_symmetry)):
        part = c.select("id", E.to_coe(fn(harm)).alias("coe"))
        out.append(E.long_coefficients(part).withColumnRenamed("value", name))
    return out[0].join(out[1], ["id", "letter", "h"]).select(
        "id", "letter", "h", r6(F.col("sym")).alias("sym"), r6(F.col("asym")).alias("asym"))


@query("efa_12", """WITH @ctr, cs AS (SELECT id, sqrt(avg(x*x + y*y)) AS k FROM ctr GROUP BY id),
f AS (SELECT id, arg_min(seq, (abs(x), seq)) AS s0 FROM ctr WHERE y > 0 GROUP BY id)
SELECT c.id, ((seq - s0 + 64) % 64 + 1)::INT AS seq, R6(x/k) AS x, R6(y/k) AS y FROM ctr c JOIN cs USING (id) JOIN f ON f.id = c.id""")
def normalisation_pipeline(spark, d):
    return long(X.outlines(spark, d), E.normalise_shape(F.col("coo"), "up"))
