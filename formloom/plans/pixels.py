"""Queries img_*: every image of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.base import r6
from ..operators import pixels as I
from .registry import query


def _weighted(v, width):
    """White pixels and their position-weighted sum of one image row."""
    spots = F.transform(v, lambda e, i: e * (F.floor(i / width) * 101 + i % width))
    return [F.aggregate(v, F.lit(0.0), lambda a, e: a + e).alias("white"),
            F.aggregate(spots, F.lit(0.0), lambda a, e: a + e).alias("checksum")]


def _stats(images, *keys):
    return images.select("img", *keys, "height", "width", F.size("v").cast("bigint").alias("n"),
                         *_weighted(F.col("v"), F.col("width")))


def _sql(src, *keys, h="h", w="w"):
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT img, {k}{h}::INT AS height, {w}::INT AS width, count(*) AS n, sum(v)::DOUBLE AS white, sum(v*(r*101 + c))::DOUBLE AS checksum FROM ({src}) GROUP BY img, {k}{h}, {w}"""


@query("img_01", "WITH @pix, " + """o AS (SELECT img, k//54 AS r, k%54 AS c FROM (SELECT DISTINCT img FROM pix), range(0, 2916) t(k)),
j AS (SELECT o.*, CASE WHEN r BETWEEN 3 AND 50 AND c BETWEEN 3 AND 50 THEN floor((r - 3 + 0.5)*32/48)::INT END AS sr, floor((c - 3 + 0.5)*32/48)::INT AS sc FROM o),
z AS (SELECT j.img, j.r, j.c, coalesce(p.v, 1.0) AS v, 54 AS h, 54 AS w FROM j LEFT JOIN pix p ON p.img = j.img AND p."row" = sr AND p.col = sc) """
       + "SELECT *, true AS success FROM (" + _sql("SELECT * FROM z") + ")")
def resized(spark, d):
    r = I.resize(X.images(spark, d), width=48, padding=3)
    return _stats(r, "success")


@query("img_02", "WITH @pix " + _sql("""SELECT img, 'right' AS side, "row" AS r, col - 13 AS c, v, 32 AS h, 16 AS w FROM pix WHERE col >= 13 AND col < 29
UNION ALL SELECT img, 'left', "row", col - 3, v, 32, 16 FROM pix WHERE col >= 3 AND col < 19""", "side"))
def halves(spark, d):
    return _stats(I.half_crop(X.images(spark, d), "both", 10), "side")


_SPLIT = """SELECT img, CASE WHEN col < 10 THEN 'left' WHEN col < 22 THEN 'middle_1' ELSE 'right' END AS part, "row" AS r,
col - CASE WHEN col < 10 THEN 0 WHEN col < 22 THEN 10 ELSE 22 END AS c, v, 32 AS h, CASE WHEN col < 10 THEN 10 WHEN col < 22 THEN 12 ELSE 10 END AS w FROM pix"""


@query("img_03", "WITH @pix " + _sql(_SPLIT, "part"))
def parts(spark, d):
    return _stats(I.split(X.images(spark, d), [0.3, 0.7]), "part")


@query("img_04", "WITH @pix " + _sql(f"SELECT img, part, r, CASE WHEN part = 'middle_1' THEN w - 1 - c ELSE c END AS c, v, h, w FROM ({_SPLIT})", "part"))
def mirrored(spark, d):
    return _stats(I.split(X.images(spark, d), [0.3, 0.7], mirror="second"), "part")


_SIDE = """sd AS (SELECT img, CASE WHEN round(stddev_samp(v) FILTER (col < 16), 9) > round(stddev_samp(v) FILTER (col >= 16), 9) THEN 'left' ELSE 'right' END AS side FROM pix GROUP BY img)"""


@query("img_05", f"WITH @pix, {_SIDE} " + _sql("""SELECT img, "row" AS r, CASE WHEN side = 'right' THEN col + 32 ELSE col END AS c, v, 32 AS h, 64 AS w FROM pix JOIN sd USING (img)
UNION ALL SELECT img, "row", CASE WHEN side = 'right' THEN 31 - col ELSE 63 - col END, v, 32, 64 FROM pix JOIN sd USING (img)"""))
def completed(spark, d):
    return _stats(I.complete(X.images(spark, d), "both_sides"))


@query("img_06", f"WITH @pix, {_SIDE} SELECT img, side FROM sd")
def sides(spark, d):
    return I.half_sides(X.images(spark, d))


@query("img_07", """WITH @pix, b AS (SELECT img, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pix WHERE v <> 1 GROUP BY img) """
       + _sql("""SELECT img, "row" - r0 AS r, col - c0 AS c, v, r1 - r0 + 1 AS h, c1 - c0 + 1 AS w FROM pix JOIN b USING (img) WHERE "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1"""))
def cropped(spark, d):
    return _stats(I.crop_to_content(X.images(spark, d)))


@query("img_08", """WITH @pix, n AS (SELECT img, count(DISTINCT v) AS nv FROM pix GROUP BY img), z AS (SELECT p.img, k//20 AS r, k%20 AS c, v FROM range(0, 320) t(k)
JOIN pix p ON p."row" = floor((k//20 + 0.5)*32/16)::INT AND p.col = floor((k%20 + 0.5)*32/20)::INT)
SELECT img, nv::INT AS n_values, nv <= 10 AS "binary", sum(v*(r*101 + c))::DOUBLE AS checksum FROM z JOIN n USING (img) GROUP BY img, nv""")
def checked(spark, d):
    im = X.images(spark, d)
    std = I.standardise_size(im, 20, 16)
    return I.binary_check(im).join(std.select("img", _weighted(F.col("v"), F.col("width"))[1]), "img")


_MORPH = """pl AS (SELECT img AS a, lead(img) OVER (ORDER BY img) AS b FROM (SELECT DISTINCT img FROM pix)), ps AS (SELECT a, b, step, step/3.0 AS al FROM pl, range(1, 3) t(step) WHERE b IS NOT NULL),
mj AS (SELECT ps.*, p."row" AS r, p.col AS c, p.v AS va, q.v AS vb FROM ps JOIN pix p ON p.img = a JOIN pix q ON q.img = b AND q."row" = p."row" AND q.col = p.col)"""


def _morph_sql(weight):
    return f"SELECT a, b, step::INT AS step, sum(on_)::DOUBLE AS white, sum(on_*(r*101 + c))::DOUBLE AS checksum FROM (SELECT *, CASE WHEN (1 - {weight})*va + {weight}*vb > 0.5 THEN 1 ELSE 0 END AS on_ FROM mj) GROUP BY a, b, step"


def _morph_stats(m):
    return m.select("a", "b", "step", *_weighted(F.col("v"), F.col("width")))


@query("img_09", f"WITH @pix, {_MORPH} SELECT 'linear' AS method, * FROM ({_morph_sql('al')}) UNION ALL SELECT 'spline', * FROM ({_morph_sql('(al**3*(al*(al*6 - 15) + 10))')})")
def morphs(spark, d):
    p = X.images(spark, d)
    out = None
    for m in ("linear", "spline"):
        s = _morph_stats(I.morph_sequence(p, 2, m)).withColumn("method", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out


@query("img_10")
def distance_morphs(spark, d):
    im = X.images(spark, d)
    return _morph_stats(I.morph_distance_sequence(im, 2, threshold=0.2))


@query("img_11", """SELECT vec_id AS a, lead(vec_id) OVER (ORDER BY vec_id) AS b, step::INT AS step, R6(step/4.0) AS alpha FROM embeddings, (SELECT 1 AS step) QUALIFY b IS NOT NULL
UNION ALL SELECT * FROM (SELECT vec_id, lead(vec_id) OVER (ORDER BY vec_id) AS b, 2::INT, R6(0.5) FROM embeddings) WHERE b IS NOT NULL
UNION ALL SELECT * FROM (SELECT vec_id, lead(vec_id) OVER (ORDER BY vec_id) AS b, 3::INT, R6(0.75) FROM embeddings) WHERE b IS NOT NULL""")
def planned(spark, d):
    return I.plan(X.images(spark, d), "sequence", 3).select("a", "b", "step", r6(F.col("alpha")).alias("alpha"))
