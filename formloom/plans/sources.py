"""Queries src_*: text files written from the tables and read back, models, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import outline as O
from ..functions.base import r6
from ..operators import pca as P
from ..operators.pixels import threshold_and_pad
from ..session import scratch
from ..sources import images as I
from ..sources import model as M
from ..sources import text as S
from .outline import long
from .registry import query

DIR_ID = r"id=([^/]+)/"


@query("src_01", "WITH @pts SELECT id, seq, R6(x) AS x, R6(y) AS y FROM pts")
def outline_files(spark, d):
    path = scratch(spark, "txt")
    S.write_bundles(S.outline_records(X.outlines(spark, d)), path)
    o = S.read_outlines(spark, path, bundled=True)
    return long(o.select(F.col("id").cast("bigint").alias("id"), "coo"), F.col("coo"))


@query("src_02", """WITH @pts SELECT 's' || id AS specimen, 0.5::DOUBLE AS scale, 'curve' AS part, 1::INT AS part_no, seq, R6(x) AS x, R6(y) AS y FROM pts
UNION ALL SELECT 's' || l.id, 0.5, 'landmark', 0, i::INT, R6(x), R6(y) FROM (SELECT vec_id AS id, unnest([1 + vec_id % 8, 17, 33, 49]) AS s,
unnest([1, 2, 3, 4]) AS i FROM embeddings) l JOIN pts p ON p.id = l.id AND p.seq = l.s""")
def tps_files(spark, d):
    path = scratch(spark, "tps")
    S.write_tps(X.landmarks(X.outlines(spark, d)), path)
    t = S.read_tps(spark, path)
    return t.select("specimen", "scale", "part", "part_no", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


_LOCI = """SELECT 'arc' || ((seq - 1)//16) AS locus, id, (seq - 1)%16 + 1 AS k, x, y FROM pts"""


def _loci(o):
    """Four curves of 16 points of every outline."""
    part = F.explode(F.array(*[F.struct(F.lit(f"arc{i}").alias("locus"), F.slice("coo", 16 * i + 1, 16).alias("coo")) for i in range(4)]))
    return o.select(F.col("id").alias("specimen"), part.alias("c")).select("specimen", "c.*")


@query("src_03", f"WITH @pts SELECT locus, id AS specimen, k::INT AS seq, R6(x) AS x, R6(y) AS y FROM ({_LOCI})")
def curve_files(spark, d):
    path = scratch(spark, "curves")
    S.write_bundles(S.curve_records(_loci(X.outlines(spark, d))), path)
    c = S.read_curve_points(spark, path, bundled=True).withColumn("specimen", F.col("specimen").cast("bigint"))
    return long(c, F.col("coo"), "locus", "specimen")


@query("src_04", """WITH @pts SELECT l.id AS specimen, 'lm' || i AS name, R6(x) AS x, R6(y) AS y FROM (
SELECT vec_id AS id, unnest([1 + vec_id % 8, 17, 33, 49]) AS s, unnest([1, 2, 3, 4]) AS i FROM embeddings) l
JOIN pts p ON p.id = l.id AND p.seq = l.s""")
def landmark_files(spark, d):
    path = scratch(spark, "marks")
    o = X.landmarks(X.outlines(spark, d)).select("id", F.posexplode(O.extract(F.col("coo"), F.col("ldk"))).alias("i", "p"))
    marks = o.select(F.col("id").alias("specimen"), F.concat(F.lit("lm"), (F.col("i") + 1).cast("string")).alias("name"), "p.x", "p.y")
    S.write_bundles(S.landmark_records(marks), path)
    m = S.read_landmark_points(spark, path, bundled=True)
    return m.select(F.col("specimen").cast("bigint").alias("specimen"), "name", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("src_05", f"WITH @pts SELECT locus, id AS specimen, k::INT AS seq, R6(x) AS x, R6(y) AS y FROM ({_LOCI})")
def roll_up(spark, d):
    p = X.points(spark, d).select(
        F.col("id").alias("specimen"), F.concat(F.lit("arc"), F.floor((F.col("seq") - 1) / 16).cast("string")).alias("locus"),
        ((F.col("seq") - 1) % 16 + 1).alias("seq"), "x", "y")
    return long(S.by_locus(p), F.col("coo"), "locus", "specimen")


@query("src_06")
def traced_outlines(spark, d):
    return long(I.extract_outlines(X.images(spark, d)).withColumnRenamed("img", "id"), F.col("coo"))


@query("src_07", """WITH @pix, f AS (SELECT img, max(CASE WHEN ("row" IN (0, 31) OR col IN (0, 31)) AND v <> 1 THEN 2 ELSE 0 END) AS pad FROM pix GROUP BY img),
m AS (SELECT img, 32 + 2*pad AS side, "row" + pad AS "row", col + pad AS col, CASE WHEN v > 0.5 THEN 1.0 ELSE 0.0 END AS v FROM pix JOIN f USING (img)),
e AS (SELECT img, 36 AS side, r AS "row", c AS col, 1.0 AS v FROM f, range(0, 36) a(r), range(0, 36) b(c) WHERE pad > 0
AND (r < 2 OR c < 2 OR r > 33 OR c > 33))
SELECT img, side::INT AS side, count(*) AS n, sum(v)::DOUBLE AS white, sum(v*("row"*37 + col))::DOUBLE AS checksum FROM (SELECT * FROM m UNION ALL SELECT * FROM e) GROUP BY img, side""")
def padded_pixels(spark, d):
    p = I.to_pixels(threshold_and_pad(X.images(spark, d)))
    return p.groupBy("img", F.col("width").alias("side")).agg(
        F.count("*").alias("n"), F.sum("v").alias("white"), F.sum(F.col("v") * (F.col("row") * 37 + F.col("col"))).alias("checksum"))


_SCORES = 'WITH @scores SELECT "ID", ' + ", ".join(f'R6("PC{i}") AS "PC{i}"' for i in range(1, 9)) + " FROM scores"


def _rounded(df):
    return df.select(F.col("ID").cast("bigint").alias("ID"), *[r6(F.col(c)).alias(c) for c in S.pc_columns(df.columns)])


@query("src_08", _SCORES)
def score_csv(spark, d):
    path = scratch(spark, "scores")
    X.scores(spark, d).write.option("header", True).csv(path)
    return _rounded(S.read_scores(spark, path))


@query("src_11", _SCORES)
def score_parquet(spark, d):
    path = scratch(spark, "scores")
    S.write_scores(X.scores(spark, d), path)
    return _rounded(S.read_scores(spark, path, "parquet"))


_MODEL = """SELECT 'rotation' AS part, pos::INT AS pos, pc::INT AS pc, R6(loading) AS value FROM rot
UNION ALL SELECT 'center', pos::INT, 0, R6(m) FROM mn
UNION ALL SELECT 'sdev', 0, pc::INT, R6(sdev) FROM sdv
UNION ALL SELECT 'variance', 0, pc::INT, R6(100*sdev**2/(SELECT sum(sdev**2) FROM sdv)) FROM sdv"""


def _model_rows(m):
    rot = m.rotation.select(F.lit("rotation").alias("part"), "pos", "pc", F.col("loading").alias("value"))
    cen = m.center.select(F.lit("center").alias("part"), "pos", F.lit(0).alias("pc"), "value")
    sd = m.sdev.select(F.lit("sdev").alias("part"), F.lit(0).alias("pos"), "pc", F.col("sdev").alias("value"))
    var = m.sdev.select(F.lit("variance").alias("part"), F.lit(0).alias("pos"), "pc", F.col("variance_pct").alias("value"))
    out = rot.unionByName(cen).unionByName(sd).unionByName(var)
    return out.select("part", "pos", "pc", r6(F.col("value")).alias("value"))


@query("src_09", f"WITH @sdv {_MODEL}")
def model_saved(spark, d):
    basis, _ = X.model_tables(spark, d)
    path = scratch(spark, "model")
    M.save_model(P.to_tables(spark, basis, 6), path)
    return _model_rows(M.load_model_folder(spark, path, validate=False))


@query("src_10", """WITH @mn SELECT 24::BIGINT AS n_coef, 5::BIGINT AS n_axes, '6' AS harmonics, count(*) AS n_center, R6(sum(m)) AS center_sum FROM mn""")
def model_checked(spark, d):
    basis, _ = X.model_tables(spark, d)
    path = scratch(spark, "model")
    M.save_model(P.to_tables(spark, basis, 6), path)
    m = M.load_model(spark, f"{path}/rotation", f"{path}/center", f"{path}/sdev")
    return m.center.agg(F.count("*").alias("n_center"), r6(F.sum("value")).alias("center_sum")).select(
        m.rotation.agg(F.count_distinct("coefficient")).scalar().alias("n_coef"),
        m.rotation.agg(F.count_distinct("pc")).scalar().alias("n_axes"),
        m.meta.filter("key = 'harmonics'").select("value").scalar().alias("harmonics"), "n_center", "center_sum")


@query("src_12", """WITH @pts SELECT id AS shape, seq AS point, R6(x) AS x, R6(y) AS y FROM pts""")
def outline_csv(spark, d):
    path = scratch(spark, "csv")
    X.points(spark, d).select(F.col("id").alias("shape"), F.col("seq").alias("point"), "x", "y").write.option(
        "header", True).csv(path)
    return spark.read.option("header", True).schema("shape bigint, point int, x double, y double").csv(path).select(
        "shape", "point", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("src_13", """SELECT p_partkey AS id, split_part(replace(p_name, ' ', '_'), '_', 1) AS first, split_part(replace(p_name, ' ', '_'), '_', 2) AS second FROM part""")
def name_factors(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("name"))
    return S.name_structure(p, "name", ["first", "second"]).select("id", "first", "second")


@query("src_13_odd", """WITH n AS (SELECT doc_id, len(string_split(source || '_' || CASE WHEN doc_id % 50 = 0 THEN 'x_y' ELSE 'z' END, '_')) AS n_parts FROM documents),
m AS (SELECT n_parts AS modal FROM n GROUP BY n_parts ORDER BY count(*) DESC, n_parts LIMIT 1)
SELECT doc_id, n_parts::INT AS n_parts FROM n, m WHERE n_parts <> modal""")
def odd_names(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", F.concat_ws(
        "_", "source", F.when(F.col("doc_id") % 50 == 0, "x_y").otherwise("z")).alias("name"))
    return S.odd_names(t, "name").select("doc_id", "n_parts")


@query("src_14", r"""SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\.[[:alnum:]]+$', '') AS stem,
string_split(url, '/')[-1] AS base FROM pages""")
def stems(spark, d):
    return X.table(spark, d, "pages").select("page_id", S.stem(F.col("url")).alias("stem"), S.basename(F.col("url")).alias("base"))


@query("src_15", "SELECT vec_id AS id, 1::BIGINT AS n_files FROM embeddings")
def listed_files(spark, d):
    path = scratch(spark, "list")
    S.write_outlines(X.outlines(spark, d), path)
    found = S.list_files(spark, path, extensions=("txt", "TXT"))
    return found.groupBy(F.regexp_extract("path", DIR_ID, 1).cast("bigint").alias("id")).agg(F.count("*").alias("n_files"))
