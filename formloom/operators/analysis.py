"""The whole way from images or outlines to a saved morphospace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import efa as E
from ..functions import outline as O
from ..session import cut
from ..sources.images import extract_outlines
from ..sources.model import Model, save_model
from . import fourier, pca
from .hull import with_hull


@dataclass
class Analysis:
    """``shapes(id, size, centroid)`` of the outlines as they came, ``coefs(id, coe)``, the basis,
    ``scores(id, pc, score)``, ``summary(pc, ...)`` and the model tables."""

    shapes: DataFrame
    coefs: DataFrame
    basis: pca.Basis
    scores: DataFrame
    summary: DataFrame
    model: Model


def shape_analysis(outlines: DataFrame, norm: bool = True, nb_h: int | None = None, start_point: str = "left",
                   align: bool = False) -> Analysis:
    """Centre, scale and slide the outlines (``id, coo``), then Fourier coefficients, PCA and scores.

    Without ``nb_h`` the harmonics reach 99 % of the power.  Rows without a
    valid outline are left out of all tables.
    """
    spark = outlines.sparkSession
    rows = outlines.filter(F.coalesce(O.is_shape(F.col("coo")), F.lit(False)))
    shapes = rows.select("id", O.centroid_size(F.col("coo")).alias("size"), O.centroid(F.col("coo")).alias("centroid"))
    ready = with_hull(rows) if align else rows
    caliper = F.col("caliper") if align else None
    placed = cut(ready.select("id", E.normalise_shape(F.col("coo"), start_point, caliper).alias("coo")))
    nb_h = fourier.automatic_harmonics(placed) if nb_h is None else nb_h
    coefs = cut(E.efourier(placed, nb_h, norm=norm, start=True))
    basis = pca.fit(coefs)
    scores = pca.long_scores(pca.project(coefs, basis))
    model = pca.to_tables(spark, basis, None, {"norm": str(norm).upper(), "start_point": start_point})
    return Analysis(shapes, coefs, basis, scores, pca.scree(model.sdev), model)


def analyse_images(images: DataFrame, path: str | None = None, **options) -> Analysis:
    """``shape_analysis`` of image rows; ``path`` saves the model. Images without an outline have no row in the result."""
    found = extract_outlines(images).filter("status = 'ok'").select(F.col("img").alias("id"), "coo")
    out = shape_analysis(cut(found), **options)
    if path is not None:
        save_model(out.model, path)
    return out
