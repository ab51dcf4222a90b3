"""PCA, stability, saturation, gaps and clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom import fixtures as X
from formloom.functions import efa as E
from formloom.operators import cluster, gaps, pca, resample, stability
from formloom.sources import model


@pytest.fixture(scope="module")
def coefs(spark, sf):
    return E.efourier(X.outlines(spark, sf), 6).persist()


def test_pca_matches_numpy(spark, coefs):
    m = np.array([r.coe for r in coefs.collect()])
    fit = pca.fit(coefs)
    val = np.linalg.eigvalsh(np.cov(m.T))[::-1]
    assert fit.sdev[:10] == pytest.approx(np.sqrt(val[:10]))
    s = np.array([r.scores for r in pca.project(coefs, fit).collect()])
    assert s.std(axis=0, ddof=1)[:10] == pytest.approx(fit.sdev[:10])
    assert np.abs(s.mean(axis=0)).max() < 1e-10
    top = np.abs(fit.rotation).argmax(axis=0)
    assert (fit.rotation[top, range(fit.rotation.shape[1])] > 0).all()


def test_constant_column_cannot_be_scaled(coefs):
    with pytest.raises(ValueError, match="constant"):
        pca.fit(coefs, scale=True)


def test_center_is_the_zero_shape(spark, coefs):
    fit = pca.fit(coefs)
    req = spark.createDataFrame([(1, [0.0]), (2, [0.0] * 40)], "id int, scores array<double>")
    a, b = (r.shape for r in pca.reconstruct(req, fit).orderBy("id").collect())
    flat = spark.createDataFrame([(fit.center.tolist(),)], "coe array<double>")
    want = E.with_inverse(flat, E.from_coe(F.col("coe"))).first().shape
    assert np.allclose(np.array(a), np.array(want)) and np.allclose(np.array(a), np.array(b))


def test_model_round_trip(spark, coefs, tmp_path):
    fit = pca.fit(coefs)
    m = pca.to_tables(spark, fit, meta={"norm": "TRUE"})
    model.save_model(m, str(tmp_path / "m"))
    back = pca.from_tables(model.load_model_folder(spark, str(tmp_path / "m")))
    assert np.allclose(back.rotation, fit.rotation) and np.allclose(back.center, fit.center) and np.allclose(back.sdev, fit.sdev)
    assert model.load_model_folder(spark, str(tmp_path / "m")).meta.filter("key = 'norm'").first().value == "TRUE"


def test_axis_shift_to_itself_is_zero(spark, coefs):
    rot = pca.to_tables(spark, pca.fit(coefs)).rotation
    a = stability.axis_shift(rot.withColumn("run", F.lit(1)), rot, ["run"]).agg(F.max("angle_deg").alias("a")).first().a
    assert a == pytest.approx(0, abs=1e-4)


def test_stability_of_everything(spark, sf):
    runs, models, ref = stability.stability(X.outlines(spark, sf), [0.2, 1.0], 2, nb_h=4, resolution=10, max_pcs=3)
    rows = {(r.fraction, r.repeat_id): r for r in runs.collect()}
    n = X.outlines(spark, sf).count()
    assert len(rows) == 4 and rows[(1.0, 1)].realized_n == n
    full = rows[(1.0, 2)]
    assert full.subspace_similarity == pytest.approx(1) and full.occupancy_similarity == pytest.approx(1)
    assert rows[(0.2, 1)].occupancy_grid_iou < 1
    m = models.filter("fraction = 1.0 and repeat_id = 1").first()
    assert np.allclose(m.center, ref.center)


def test_draws_have_the_asked_size(spark):
    ids = spark.range(500)
    t = stability.tasks(ids.agg(F.count("*").alias("n")), [0.1, 0.5], 2)
    s = stability.draw_samples(ids, t, 3)
    assert sorted(r["count"] for r in s.groupBy("fraction", "repeat_id").count().collect()) == [50, 50, 250, 250]
    assert s.groupBy("fraction", "repeat_id", "id").count().filter("count > 1").count() == 0


def test_saturation_grows(spark, sf):
    s = resample.saturation(X.scores(spark, sf, 3), [0.05, 0.2, 1.0], 20).filter("metric_type = 'total_variance'")
    m = [r["mean"] for r in s.orderBy("sample_size").collect()]
    assert m[0] < m[1] < m[2]
    assert resample.size_schedule([0.001, 0.5, 7, 900], 100) == [7, 50]


# ---- the two gap examples -------------------------------------------------------------


def two_clusters(spark):
    rng = np.random.default_rng(123)
    p = np.vstack([rng.normal((m, 0), (0.5, 0.5), (50, 2)) for m in (-2, 2)])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "ID long, PC1 double, PC2 double")


def test_gap_between_clusters(spark):
    r = gaps.detect_gaps(two_clusters(spark), ["PC1", "PC2"], resolution=40, mc=10, bootstraps=5, thresholds=(0.8, 0.9))
    s = r["summary"].filter("threshold = 0.8").orderBy(F.desc("area")).collect()
    assert any(abs(g.centroid_x) < 1.2 and g.area > 0.5 for g in s)
    c = r["certainty"].agg(F.min("certainty").alias("a"), F.max("certainty").alias("z")).first()
    assert 0 <= c.a and c.z <= 1


def test_domain_reference(spark):
    rng = np.random.default_rng(42)
    rows = [(i, "A", *map(float, rng.normal((-1, 0), 0.4))) for i in range(60)]
    rows += [(60 + i, "B", *map(float, rng.normal((3, 2), 0.6))) for i in range(40)]
    df = spark.createDataFrame(rows, "ID long, Group string, PC1 double, PC2 double")
    run = lambda **k: gaps.detect_gaps(df, ["PC1", "PC2"], resolution=12, mc=2, bootstraps=2, thresholds=(0.8,),
                                       domain_mode="full", **k)["grid"].first()
    whole = run()
    assert run(group="Group", groups=["A"], domain_reference="all") == whole
    assert run(group="Group", groups=["A"], domain_reference="subset") != whole


@pytest.mark.parametrize("estimation,method", [("two_stage", "radius"), ("bootstrap_mc", "kde")])
def test_other_estimators(spark, estimation, method):
    r = gaps.detect_gaps(two_clusters(spark), ["PC1", "PC2"], resolution=10, mc=2, mc_bootstrap=2, bootstraps=2,
                         estimation=estimation, method=method, kind="uniform")
    assert r["certainty"].filter("certainty between 0 and 1").count() == r["certainty"].count() > 0


def test_draw_words(spark):
    rows = [(0, 0, 0, m) for m in list(range(1, 200)) * 2] + [(0, 1, 0, 64)]
    df = spark.createDataFrame(rows, "pair int, ix int, iy int, m int")
    assert {r.ix: r.hits for r in gaps.count_draws(df, ["pair", "ix", "iy"]).collect()} == {0: 199, 1: 1}


def test_alpha_domain_drops_isolated_points(spark):
    rng = np.random.default_rng(5)
    p = [(i, *map(float, rng.random(2))) for i in range(200)] + [(999, 10.0, 10.0), (1000, 3.0, 0.0), (1001, 3.1, 0.0)]
    df = spark.createDataFrame([("a", *r) for r in p], "pair string, id long, x double, y double")
    for alpha in (0.06, 0.2):
        kept = {r.id for r in gaps.alpha_points(df, alpha).collect()}
        want = {i for i, x, y in p if any(j != i and np.hypot(x - u, y - v) <= 2 * alpha for j, u, v in p)}
        assert kept == want


def test_regions_touch_along_sides(spark):
    cells = [(0, 0), (1, 0), (1, 1), (3, 3), (2, 2)]
    df = spark.createDataFrame([("a", i, j, float(i), float(j), 1.0) for i, j in cells],
                               "pair string, ix int, iy int, x double, y double, certainty double")
    got = {(r.ix, r.iy): r.gap_id for r in gaps.label_regions(df, [0.5]).collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (1, 1): 1, (2, 2): 2, (3, 3): 3}


# ---- clusters ------------------------------------------------------------------------------


def test_silhouette_and_dispersion_follow_from_sums(spark):
    rng = np.random.default_rng(7)
    p = np.round(rng.random((120, 2)), 1) + 50
    c = rng.integers(0, 3, 120)
    c[0] = 9  # a cluster of one
    df = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(p, c))],
                               "id long, x double, y double, c int")
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    own = [d[i, c == c[i]].sum() / max((c == c[i]).sum() - 1, 1) for i in range(120)]
    other = [min(d[i, c == k].mean() for k in set(c.tolist()) if k != c[i]) for i in range(120)]
    got = {r.id: r.width for r in cluster.silhouette(df, ["x", "y"], "c", "id").collect()}
    assert [got[i] for i in range(120)] == pytest.approx([0] + [(b - a) / max(a, b) for a, b in zip(own[1:], other[1:])])
    w = cluster.dispersion(df, ["x", "y"], "c")
    assert w == pytest.approx(sum(d[np.ix_(c == k, c == k)].sum() / (c == k).sum() / 4 for k in set(c.tolist())))


def test_kmeans_finds_two_groups(spark):
    s = two_clusters(spark)
    out = cluster.kmeans(s, ["PC1", "PC2"], 2, nstart=3)
    sides = {(r.cluster, r.right): r["count"] for r in out.groupBy("cluster", (F.col("ID") >= 50).alias("right")).count().collect()}
    assert max(sides.values()) == 50 and sum(v for v in sides.values() if v < 25) < 10
    rows = out.select("PC1", "PC2", "cluster").collect()
    at = {c: np.mean([(r.PC1, r.PC2) for r in rows if r.cluster == c], axis=0) for c in (1, 2)}
    for r in rows:  # every row is with its nearest centre
        assert r.cluster == min(at, key=lambda c: (r.PC1 - at[c][0]) ** 2 + (r.PC2 - at[c][1]) ** 2)


def test_wide_model_round_trip(spark, tmp_path):
    p = 450
    basis = pca.Basis(np.arange(p, dtype=float), np.linalg.qr(np.random.default_rng(1).random((p, p)))[0], np.ones(p))
    model.save_model(pca.to_tables(spark, basis), str(tmp_path / "wide"))
    back = pca.from_tables(model.load_model_folder(spark, str(tmp_path / "wide")))
    assert back.rotation.shape == (p, p) and np.allclose(back.rotation, basis.rotation) and np.allclose(back.center, basis.center)


def test_first_se_max(spark):
    g = spark.createDataFrame([(1, 0.1, 0.05), (2, 0.48, 0.05), (3, 0.5, 0.05), (4, 0.4, 0.05)], "k int, gap double, se double")
    assert cluster.first_se_max(g).first().k == 2
