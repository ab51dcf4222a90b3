"""PCA models as tables: rotation, center, sdev and key/value metadata.

In memory a model is a small ``Model`` of long tables.  Their size is the
number of coefficients times the number of axes, never the number of specimens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Model:
    """``rotation(coefficient, pos, pc, loading)``, ``center(coefficient, pos, value)``,
    ``sdev(pc, sdev, variance_pct)``, ``meta(key, value)``."""

    rotation: DataFrame
    center: DataFrame
    sdev: DataFrame
    meta: DataFrame


def coefficient_name(pos, nb_h):
    """``A1..An B1..Bn C1..Cn D1..Dn`` for positions 1..4n."""
    k = pos - 1
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.floor(k / nb_h).cast("int") + 1),
                    (k % nb_h + 1).cast("int").cast("string"))


def save_model(model: Model, path: str) -> None:
    """Four folders; the rotation is long, one CSV row per coefficient and axis."""
    model.rotation.select("coefficient", "pos", "pc", "loading").write.option("header", True).csv(f"{path}/rotation")
    model.center.select("coefficient", "pos", "value").write.option("header", True).csv(f"{path}/center")
    model.sdev.select(F.concat(F.lit("PC"), F.col("pc").cast("string")).alias("PC"), "sdev",
                      "variance_pct").write.option("header", True).csv(f"{path}/sdev")
    model.meta.select(F.concat_ws(": ", "key", "value").alias("value")).write.text(f"{path}/metadata")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _coef_position(names: DataFrame) -> DataFrame:
    """Position of ``A1..D<n>`` names when a table has no ``pos`` column."""
    letter = F.expr("locate(substr(coefficient, 1, 1), 'ABCD')")
    n = names.count() // 4
    return names.withColumn("pos", ((letter - 1) * n + F.expr("cast(substr(coefficient, 2) as int)")).cast("int"))


def load_model(spark: SparkSession, rotation: str, center: str, sdev: str,
               metadata: str | None = None, validate: bool = True) -> Model:
    """Read and check a model; a missing harmonic count becomes rows/4.

    The rotation is long (``pc``, ``loading``) or wide (one ``PC<n>`` column per axis).
    """
    read, cen, sd = _csv(spark, rotation), _csv(spark, center), _csv(spark, sdev)
    if "pos" not in cen.columns:
        cen = _coef_position(cen)
    if "pos" not in read.columns:
        read = read.join(cen.select("coefficient", "pos"), "coefficient")
    if "loading" not in read.columns:
        cells = F.explode(F.array(*[F.struct(F.lit(int(c[2:])).alias("pc"), F.col(c).alias("loading"))
                                    for c in read.columns if c.startswith("PC")])).alias("r")
        read = read.select("coefficient", "pos", cells).select("coefficient", "pos", "r.pc", "r.loading")
    rot = read.select("coefficient", *[F.col(c).try_cast("int").alias(c) for c in ("pos", "pc")], F.col("loading").try_cast("double").alias("loading"))
    cen = cen.select("coefficient", F.col("pos").try_cast("int").alias("pos"), F.col("value").try_cast("double").alias("value"))
    sd = sd.select(F.expr("try_cast(substr(PC, 3) as int)").alias("pc"), F.col("sdev").try_cast("double").alias("sdev"),
                   F.col("variance_pct").try_cast("double").alias("variance_pct"))
    n_coef = cen.count()
    if validate:
        size = rot.agg(F.count_distinct("coefficient").alias("rows"), F.count_distinct("pc").alias("axes")).first()
        if size.rows != n_coef:
            raise ValueError("rotation rows and center values differ")
        if sd.count() < size.axes:
            import warnings
            warnings.warn("fewer sdev rows than rotation axes", stacklevel=2)
    if metadata is None:
        meta = spark.createDataFrame([], T.StructType([
            T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
    else:
        lines = spark.read.text(metadata).filter(F.col("value").contains(":"))
        meta = lines.select(F.trim(F.regexp_extract("value", r"^([^:]+):", 1)).alias("key"),
                            F.trim(F.regexp_extract("value", r"^[^:]+:(.*)$", 1)).alias("value"))
    if meta.filter("key = 'harmonics'").limit(1).count() == 0:
        meta = meta.unionByName(cen.agg(F.lit("harmonics").alias("key"),
                                        F.floor(F.count("*") / 4).cast("string").alias("value")))
    return Model(rot, cen, sd, meta)


def load_model_folder(spark: SparkSession, path: str, validate: bool = True) -> Model:
    """The layout ``save_model`` writes."""
    return load_model(spark, f"{path}/rotation", f"{path}/center", f"{path}/sdev", f"{path}/metadata", validate)
