import numpy as np
import pytest
from conftest import outline
from pyspark.sql import functions as F

from formloom import fixtures as X
from formloom.operators import analysis, fourier, pca
from formloom.sources import model


def test_automatic_harmonics(spark, sf):
    o = X.outlines(spark, sf)
    coo = [np.array([tuple(p) for p in r.coo]) for r in o.collect()]
    shares = []
    for p in coo:  # power by a discrete transform over the outline's own steps
        d = p - np.roll(p, 1, axis=0)
        t = np.hypot(*d.T)
        at = np.cumsum(t)
        h = np.arange(1, 32)[:, None]
        c, s = (f(2 * np.pi * h * at / t.sum()) - f(2 * np.pi * h * (at - t) / t.sum()) for f in (np.cos, np.sin))
        abcd = [(d[:, k] / t * w).sum(axis=1) * t.sum() / (2 * np.pi**2 * h[:, 0]**2) for k in (0, 1) for w in (c, s)]
        power = sum(x * x for x in abcd)[1:] / 2
        shares.append(100 * np.cumsum(power) / power.sum())
    want = int(np.argmax(np.median(shares, axis=0) > 99)) + 2
    assert fourier.automatic_harmonics(o) == want
    assert fourier.coefficients(o).select(F.size("coe").alias("n")).distinct().collect() == [(4 * want,)]
    small = outline(spark, [(0, 0), (1, 0), (1, 1), (0, 1)])
    assert fourier.automatic_harmonics(small) == 1


def test_images_to_saved_model(spark, sf, tmp_path):
    path = str(tmp_path / "m")
    im = X.images(spark, sf).limit(40)
    blank = im.limit(1).select(F.lit(-1).cast(im.schema["img"].dataType).alias("img"), "height", "width",
                               F.transform("v", lambda _: F.lit(1.0)).alias("v"))
    done = analysis.analyse_images(im.unionByName(blank), path)
    scores = {(r.id, r.pc): r.score for r in done.scores.collect()}
    assert len({i for i, _ in scores}) == done.shapes.count() == 40
    back = pca.from_tables(model.load_model_folder(spark, path))
    coe = {r.id: np.array(r.coe) for r in done.coefs.collect()}
    k = back.rotation.shape[1]
    for i, c in list(coe.items())[:5]:
        s = np.array([scores[i, j + 1] for j in range(k)])
        assert s == pytest.approx((c - back.center) @ back.rotation, abs=1e-9)
        assert back.center + back.rotation @ s == pytest.approx(c, abs=1e-6)  # all axes rebuild the coefficients
    m = np.array([[scores[i, j + 1] for j in range(k)] for i in coe])
    cov = np.cov(m.T)
    assert cov == pytest.approx(np.diag(np.diag(cov)), abs=1e-9)


def test_outliers_by_share(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1, float(x)) for i, x in enumerate(rng.normal(0, 10, 200))] + [(i, 2, float(x)) for i, x in enumerate(rng.normal(0, .1, 200))]
    rows[17] = (17, 1, 90.0)
    rows[225] = (25, 2, 5.0)
    s = spark.createDataFrame(rows, "id long, pc int, score double")
    assert [r.id for r in pca.outliers(s, conf=1e-6).collect()] == [17]
    assert {r.id for r in pca.outliers(s, conf=1e-6, nax=None).collect()} == {17, 25}
