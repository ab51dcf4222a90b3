"""Views of the driver's tables as outlines, scores and point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.base import TWO_PI, pt
from .session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, coo``: radius 1 + embedding at 64 equal angles."""
    coo = F.transform("embedding", lambda e, i: pt(
        (1 + e.cast("double")) * F.cos(F.lit(TWO_PI) * i / 64),
        (1 + e.cast("double")) * F.sin(F.lit(TWO_PI) * i / 64)))
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), "label", coo.alias("coo"))


def landmarks(o: DataFrame) -> DataFrame:
    """Adds ``ldk``: four landmark indices."""
    first = (1 + F.col("id") % 8).cast("int")
    return o.withColumn("ldk", F.array(first, F.lit(17), F.lit(33), F.lit(49)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_points(outlines(spark, sf_dir))


def to_points(o: DataFrame, *keep: str) -> DataFrame:
    """Long form ``id, label, seq, x, y``."""
    cols = keep or [c for c in o.columns if c != "coo"]
    return o.select(*cols, F.posexplode("coo").alias("seq", "p")).select(
        *cols, (F.col("seq") + 1).cast("int").alias("seq"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def scores(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """``ID, PC1..PCk, group``."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("ID"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"PC{i + 1}") for i in range(k)],
        F.col("label").alias("group"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, g`` from lineitem."""
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        F.col("l_returnflag").alias("g"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID, x, y, g`` with NULL, NaN and infinity at fixed residues of ID."""
    s = scores(spark, sf_dir, 2)
    x: Column = (F.when(F.col("ID") % 11 == 0, F.lit(None).cast("double"))
                 .when(F.col("ID") % 13 == 0, F.lit(float("nan")))
                 .when(F.col("ID") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("PC1")))
    return s.select("ID", x.alias("x"), F.col("PC2").alias("y"), F.col("group").alias("g"))


SIDE = 32


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 32 x 32 mask per outline: 0 inside 10 r of the nearest angle, else 1."""
    def pixel(k):
        row, col = F.floor(k / SIDE), k % SIDE
        dx, dy = (col - 16).cast("double"), (row - 16).cast("double")
        turn = F.pmod(F.atan2(dy, dx), F.lit(TWO_PI)) / F.lit(TWO_PI) * 64
        r = 1 + F.get("embedding", (F.floor(turn + 0.5) % 64).cast("int")).cast("double")
        return F.when(F.hypot(dx, dy) <= 10 * r, F.lit(0.0)).otherwise(F.lit(1.0))
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("img"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel).alias("v"))


def model_tables(spark: SparkSession, sf_dir: str, nb_h: int = 6, pcs: int = 5):
    """A model with a cosine basis as rotation; center and sdev from the data."""
    from .functions import efa
    from .operators.pca import project, table_model
    coefs = efa.efourier(outlines(spark, sf_dir), nb_h)
    return table_model(coefs, pcs), coefs
