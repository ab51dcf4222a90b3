"""Hulls, quantiles, ranks and draws against brute force, with hot groups and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.operators import density, ellipse, hull, joins, ranks, stability, tables


def cloud(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 7, n))
    rows = [(int(i), int(k), float(x), float(y)) for i, k, x, y in zip(
        range(n), g, np.round(rng.normal(0, 1, n), 1), np.round(rng.normal(0, 5, n), 1))]
    return spark.createDataFrame(rows, "id long, g int, x double, y double"), rows


def is_vertex(pts, p):
    """p is a vertex when some open half plane through p holds every other point."""
    d = np.array([q for q in pts if q != p], float) - np.array(p)
    a = np.sort(np.arctan2(d[:, 1], d[:, 0]))
    gaps = np.diff(np.concatenate([a, [a[0] + 2 * np.pi]]))
    return gaps.max() > np.pi + 1e-9


def test_hull_per_group(spark, monkeypatch):
    df, rows = cloud(spark)
    got = hull.convex_hull(df.repartition(5), ["g"], "x", "y", "id").collect()
    for k in range(7):
        pts = sorted({(x, y) for _, g, x, y in rows if g == k})
        mine = [(r.x, r.y) for r in sorted((r for r in got if r.g == k), key=lambda r: r.ord)]
        assert set(mine) == {p for p in pts if is_vertex(pts, p)}
        assert mine[0] == min(mine)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(mine, mine[1:] + mine[:1]))
        assert area < 0  # clockwise
        first = {(x, y): i for i, g, x, y in reversed(rows) if g == k}
        assert {(r.x, r.y): r.id for r in got if r.g == k} == {p: first[p] for p in mine}


def test_hull_degenerate(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 1.0, 1.0), (3, 1, 0.0, 0.0), (4, 1, 1.0, 1.0), (5, 1, 2.0, 2.0)],
                               "id long, g int, x double, y double")
    got = sorted((r.g, r.x, r.y) for r in hull.convex_hull(df, ["g"], "x", "y", "id").collect())
    assert got == [(0, 1.0, 1.0), (1, 0.0, 0.0), (1, 2.0, 2.0)]
    assert hull.hull_area(df, ["g"], "x", "y", "id").count() == 0


def test_hull_volume_of_a_cube(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float), rng.random((300, 3))])
    df = spark.createDataFrame([(0, *map(float, p)) for p in pts], "g int, a double, b double, c double")
    r = hull.hull_volume(df.repartition(4), ["g"], ["a", "b", "c"]).first()
    assert r.volume == pytest.approx(1) and r.facets == 12


@pytest.mark.parametrize("accuracy", [10, 100, 20_000])
def test_quantiles_exact(spark, accuracy):
    df, rows = cloud(spark)
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = ranks.quantiles(df.repartition(5), ["g"], "y", probs, names, [F.avg("y").alias("m")], accuracy=accuracy).collect()
    for r in got:
        v = [y for _, g, _, y in rows if g == r.g]
        assert [r[n] for n in names] == pytest.approx(list(np.quantile(v, probs)))
        assert r.m == pytest.approx(np.mean(v))
    whole = ranks.quantiles(df, [], "y", [0.5], ["m"], accuracy=accuracy).first().m
    assert whole == pytest.approx(np.median([r[3] for r in rows]))


def test_row_index(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * -1).alias("k"), (F.col("id") % 3).alias("g"))
    rows = ranks.row_index(df, "k", "i").collect()
    assert [r.i for r in sorted(rows, key=lambda r: r.k)] == list(range(1, len(rows) + 1))
    for g in range(3):
        part = [r for r in ranks.row_index(df, "k", "i", within=["g"]).collect() if r.g == g]
        assert [r.i for r in sorted(part, key=lambda r: r.k)] == list(range(1, len(part) + 1))


def test_hash_cutoffs(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"),
                                  F.lit(137).alias("k"))
    got = {r.g: r.cutoff for r in ranks.hash_cutoffs(df, ["g"], "h", "k").collect()}
    for g in (0, 1):
        assert got[g] == sorted(r.h for r in df.filter(F.col("g") == g).collect())[136]


def test_region_depth_matches_all_pairs(spark):
    df, rows = cloud(spark, 1500)
    regions = spark.createDataFrame([(g, i, float(x), float(y)) for g in range(3) for i, (x, y) in enumerate(
        [(0, 0), (9, 9), (-3, 20), (0.5, -40)])], "g int, gap_id int, centroid_x double, centroid_y double")
    got = joins.region_depth(regions, df.select("g", "x", "y"), ["g"], bins=8).collect()
    for r in got:
        want = min(np.hypot(x - r.centroid_x, y - r.centroid_y) for _, g, x, y in rows if g == r.g)
        assert r.gap_depth == pytest.approx(want)


def test_density_over_partitions(spark):
    df, rows = cloud(spark, 800)
    z = density.density(df.repartition(6), [], "x", "y", n_grid=5).collect()
    b = density.bandwidths(df, [], "x", "y").first()
    for r in z[:6]:
        want = sum(np.exp(-0.5 * ((x - r.x) / b.hx) ** 2 - 0.5 * ((y - r.y) / b.hy) ** 2) for _, _, x, y in rows)
        assert r.z == pytest.approx(want / (len(rows) * b.hx * b.hy * 2 * np.pi))


def test_robust_ellipse_resists_outliers(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(40, 1, (10, 2))])
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in p], "g int, x double, y double")
    m = ellipse.robust_moments(df, ["g"], "x", "y").first()
    plain = tables.covariance(df, ["g"], "x", "y").first()
    assert m.sxx < plain.sxx / 5 and abs(m.mx) < 0.5


def test_iou(spark):
    df, _ = cloud(spark, 500)
    a = df.select("g", "id", "x", "y")
    assert all(r.iou == pytest.approx(1) for r in stability.hull_iou_of(a, a, ["g"], "id").collect())
    assert {r.iou for r in tables.cell_iou(a, a, ["g"]).collect()} == {1.0}
    sq = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert hull.hull_iou(sq, sq + 1) == pytest.approx(1 / 7)
    assert hull.hull_iou(sq, sq + 5) == 0


def test_shared_bounds_match_direct_bins(spark):
    df, _ = cloud(spark, 900)
    runs = df.withColumn("PC1", F.col("x")).withColumn("PC2", F.col("y") + F.col("g") * 3)
    ref = runs.filter("g < 3").select("id", "PC1", "PC2")
    got = {r.g: r.grid_iou for r in stability.occupancy(runs.select("g", "id", "PC1", "PC2"), ref, ["g"], ["PC1", "PC2"], 15).collect()}
    for g in range(7):
        a = runs.filter(F.col("g") == g).select(F.lit(0).alias("k"), F.col("PC1").alias("x"), F.col("PC2").alias("y"))
        b = ref.select(F.lit(0).alias("k"), F.col("PC1").alias("x"), F.col("PC2").alias("y"))
        assert got[g] == pytest.approx(tables.cell_iou(a, b, ["k"], 15).first().iou)


@pytest.mark.parametrize("crowd", [2, 64])
def test_lookup_in_split_cells(spark, monkeypatch, crowd):
    """Points spread over many scales, equal points, and asked positions on the edge of the reach."""
    from formloom.operators import cells
    monkeypatch.setattr(cells, "CROWD", crowd)
    monkeypatch.setattr(joins, "answers", lambda *a, **k: cells.answers(*a, **{**k, "crowd": crowd}))
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.normal(0, s, (120, 2)) for s in (3, .3, .01, 1e-4)] + [np.full((90, 2), .5), rng.integers(-4, 5, (60, 2)) / 2])
    ask = np.concatenate([rng.normal(0, 1, (80, 2)), rng.integers(-6, 7, (60, 2)) / 2, p[:40]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, x double, y double").repartition(3)
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ask)], "ask long, x double, y double")
    got = {r.ask: r.found for r in joins.lookup_within(points, asked, .5).collect()}
    hit = (np.abs(ask[:, None] - p[None]) < .5).all(axis=2)
    assert got == {i: int(h.argmax()) for i, h in enumerate(hit) if h.any()}


def test_alpha_points_beside_a_crowd(spark):
    from formloom.operators import gaps
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.normal(0, .02, (300, 2)), rng.normal(0, 1, (150, 2))])
    df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pair string, id long, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    for alpha in (.01, .05, .2):
        assert {r.id for r in gaps.alpha_points(df, alpha).collect()} == set(np.flatnonzero(d.min(axis=1) <= 2 * alpha).tolist())


def test_overlap_fold_against_loops(spark):
    """The fold over edges against clipping point by point: crossing, nested, disjoint, equal and degenerate hulls."""
    rng = np.random.default_rng(21)
    sets = [(rng.normal(size=(12, 2)), rng.normal(rng.normal(scale=s), 1, (9, 2))) for s in (0, .5, 1, 2, 6) for _ in range(6)]
    sq = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    sets += [(sq, sq), (sq, sq + 1), (sq, sq + 5), (sq, sq / 4 + .5), (sq / 4 + .5, sq), (sq, sq + [2, 0]), (sq, sq[:2]), (sq[:1], sq), (sq, np.array([[0, 0], [1, 1], [2, 2]], float))]
    rows = [(k, which, i, float(x), float(y)) for k, pair in enumerate(sets) for which, pts in zip("ab", pair) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "k int, w string, id long, x double, y double")
    got = {r.k: r.iou for r in stability.hull_iou_of(df.where("w = 'a'"), df.where("w = 'b'"), ["k"], "id").collect()}
    for k, (a, b) in enumerate(sets):
        want = hull.hull_iou(a, b)
        assert got[k] is None if np.isnan(want) else got[k] == pytest.approx(want, abs=1e-12)


def test_flat_groups_shrink_in_the_first_stage():
    rng = np.random.default_rng(31)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    plane = rng.random((3000, 2))
    flat = np.column_stack([plane, np.zeros(3000)]) @ turn + 5
    assert sorted(hull.flat_hull(flat)) == sorted(hull.hull_order(*plane.T)) and not len(hull.hull_facets(flat))
    assert sorted(hull.flat_hull(np.outer(rng.permutation(50), [1.0, 2, 3]))) and len(hull.flat_hull(np.outer(rng.permutation(50), [1.0, 2, 3]))) == 2


def test_facets_of_points_on_and_in_a_sphere(spark):
    rng = np.random.default_rng(32)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    p = np.concatenate([p, rng.normal(scale=.2, size=(2000, 3))])
    f = hull.hull_facets(p)
    assert len(np.unique(f)) == 400 and len(f) == 2 * 400 - 4
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert (p @ n.T - np.einsum("ij,ij->i", n, p[f[:, 0]])).max() < 1e-9
    df = spark.createDataFrame([(i % 2, *map(float, x)) for i, x in enumerate(p)] + [(2, float(i), float(j), 0.0) for i in range(9) for j in range(9)], "g int, a double, b double, c double")
    got = {r.g: r for r in hull.hull_volume(df.repartition(5), ["g"], ["a", "b", "c"]).collect()}
    assert set(got) == {0, 1} and all(got[g].facets == len(hull.hull_facets(p[g::2])) for g in got)
