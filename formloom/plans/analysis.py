"""Queries ana_*: whole analyses with their defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.base import r6
from ..operators import analysis as A
from ..operators import pca as P
from ..session import scratch
from ..sources import model as M
from .registry import query


@query("ana_01")
def images_to_scores(spark, d):
    """Images to outlines, coefficients, axes, scores and a saved model; scores come from the model as read back."""
    path = scratch(spark, "analysis")
    done = A.analyse_images(X.images(spark, d), path)
    scores = P.long_scores(P.project(done.coefs, P.from_tables(M.load_model_folder(spark, path))))
    return scores.select("id", "pc", r6(F.col("score")).alias("score"))


@query("ana_02")
def outlines_to_summary(spark, d):
    """Outlines to the axes' shares with the automatic number of harmonics."""
    done = A.shape_analysis(X.outlines(spark, d))
    return done.summary.select("axis", r6(F.col("proportion")).alias("proportion"), r6(F.col("cumsum")).alias("cumsum"))


@query("ana_03")
def outlying(spark, d):
    """Outliers over the axes that reach 99 % of the variance."""
    return P.outliers(A.shape_analysis(X.outlines(spark, d)).scores, conf=0.1)
