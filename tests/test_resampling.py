"""Many-model k-means, draws from row keys, region labels and saturation against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.functions import draws
from formloom.operators import cluster, components, gaps, hull, kmeans, occupancy, pca, resample


def blobs(n=90, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, .4, (n // 3, 2)) for c in ((0, 0), (5, 1), (2, 6))])


def lloyd(x, k, rng):
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
    return ((x - c[near]) ** 2).sum()


def table(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")


def test_models_of_many_sets(spark):
    """Every data set and k reaches the best of many restarts, also where the pool is smaller than the data."""
    sets = [blobs(90, s) for s in range(3)]
    rows = [(i, [float(v) for s in sets for v in s[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    best = kmeans.fit_many(df, 2, [1, 2, 3, 4], nstart=80)
    assert set(best) == {(s, k) for s in range(3) for k in (1, 2, 3, 4)}
    rng = np.random.default_rng(5)
    for (s, k), f in best.items():
        want = min(lloyd(sets[s], k, rng) for _ in range(15))
        assert f.cost <= want * (1 + 1e-6)
        d = ((sets[s][:, None] - f.centres[None]) ** 2).sum(axis=2)
        assert f.cost == pytest.approx(d.min(axis=1).sum()) and f.n.sum() == 90
        for i in range(k):  # settled: every centre is the mean of its rows
            assert f.centres[i] == pytest.approx(sets[s][d.argmin(axis=1) == i].mean(axis=0))
    assert len(best[0, 3].n) == 3 and min(best[0, 3].n) == 30


def test_models_beyond_the_pool(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "POOL", 12)
    x = blobs(300, 7)
    best = kmeans.fit_many(kmeans.points_of(table(spark, x).repartition(5), ["x", "y"], "id"), 2, [3], nstart=8)
    assert sorted(best[0, 3].n) == [100, 100, 100]


def test_choices_agree(spark):
    x = table(spark, blobs())
    odd = spark.createDataFrame([(900, float("nan"), 1.0), (901, None, 2.0), (902, float("inf"), 0.0)], "id long, x double, y double")
    both = x.unionByName(odd)
    got = {r.method: r.k for r in cluster.optimal_k(both, ["x", "y"], "id", max_k=6, nstart=5, references=10).collect()}
    assert got == {"elbow": 3, "silhouette": 3, "gap": 3}
    marked = cluster.kmeans(both, ["x", "y"], 3, 5, id_col="id")
    assert {r.id for r in marked.where("cluster is null").collect()} == {900, 901, 902}
    widths = {r.k: r.silhouette for r in cluster.best_silhouette(both, ["x", "y"], "id", 3, nstart=5).collect()}
    direct = cluster.silhouette(marked.where("cluster is not null"), ["x", "y"], "cluster", "id").agg(F.avg("width")).first()[0]
    assert widths[3] == pytest.approx(direct)
    curve = {r.k: r.wcss for r in cluster.wcss_curve(both, ["x", "y"], 3, nstart=5).collect()}
    assert cluster.dispersion(marked.where("cluster is not null"), ["x", "y"], "cluster") == pytest.approx(curve[3] / 2)


def test_mixed_draws_agree(spark):
    df = spark.range(300).select("id", draws.key(F.lit(3), F.col("id")).alias("h"), (F.col("id") % 7).alias("b"))
    steps = draws.poisson_steps(1.0)
    got = df.select("h", "b", draws.mixed(F.col("h"), F.col("b"), 5).alias("m"), draws.copies(F.col("h"), F.col("b"), steps).alias("c")).toPandas()
    assert (draws.mixed_np(got.h.to_numpy(), got.b.to_numpy(), 5) == got.m).all()
    u = draws.mixed_np(got.h.to_numpy(), got.b.to_numpy()) / 2 ** 32
    assert (np.searchsorted(steps, u, "right") == got.c).all()
    many = draws.mixed_np(np.arange(200_000), 1) / 2 ** 32
    times = np.searchsorted(steps, many, "right")
    assert abs(times.mean() - 1) < .02 and abs(times.var() - 1) < .03 and abs((times == 0).mean() - math.exp(-1)) < .01


def occupied_brute(points, g, res, runs, mc, unc, seed, rate, radius):
    import hashlib
    hits = {}
    steps = draws.poisson_steps(rate) if rate is not None else None
    for b in range(1, runs + 1):
        seen = {}
        for i, x, y in points:
            h = np.array([int(hashlib.md5(f"{seed}:p:{i}".encode()).hexdigest()[:8], 16)])
            times = 1 if steps is None else int(np.searchsorted(steps, draws.mixed_np(h, b)[0] / 2 ** 32, "right"))
            for k in range(times):
                for m in range(1, mc + 1):
                    px, py = occupancy.placed(np.array([x]), np.array([y]), draws.mixed_np(h, b, k, m), (unc * g["span_x"], unc * g["span_y"]), "gaussian")
                    for ix in range(res):
                        for iy in range(res):
                            if math.hypot(g["gx0"] + ix * g["dx"] - px[0], g["gy0"] + iy * g["dy"] - py[0]) <= radius * g["cell"]:
                                seen.setdefault((ix, iy), set()).add(m)
        for c, ms in seen.items():
            t = hits.setdefault(c, [0, 0])
            t[0] += len(ms)
            t[1] += 1 - len(ms) / mc <= .5
    return {c: tuple(t) for c, t in hits.items()}


@pytest.mark.parametrize("rate,mc,scratch", [(None, 3, 1 << 26), (1.0, 5, 1 << 26), (0.5, 70, 0)])
def test_occupied_cells(spark, monkeypatch, rate, mc, scratch):
    monkeypatch.setattr(occupancy, "SCRATCH", scratch)
    rng = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(7, 2)))]
    df = spark.createDataFrame([("p", *p) for p in points], "pair string, id long, x double, y double").repartition(3)
    grid = gaps.grid(df, 9, .05)
    got = occupancy.occupied_counts(df, grid, 9, 3, mc, .2, 4, rate).collect()
    want = occupied_brute(points, grid.first().asDict(), 9, 3, mc, .2, 4, rate, 1.5)
    assert {(r.ix, r.iy): (r.hits, r.full) for r in got} == want


@pytest.mark.parametrize("kind", ["gaussian", "uniform"])
def test_crowded_cells_take_no_exact_draws(monkeypatch, kind):
    monkeypatch.setattr(occupancy, "RENEW", 2000)
    rng = np.random.default_rng(5)
    x, y = rng.normal(scale=.3, size=(2, 3000))
    x[:2], y[2:4], x[7] = (-1, 1), (-1, 1), np.nan
    g = {"gx0": -1.1, "gy0": -1.1, "dx": 2.2 / 19, "dy": 2.2 / 19, "cell": 2.2 / 19}
    m, reach = np.arange(1, 6), (.1, .1)
    quick, plain, exact = occupancy._ByteMarks(g, 20, 1, 1.5), occupancy._Marks(400, 1), []
    for at in range(0, len(x), 100):
        h = draws.mixed_32(np.arange(at, at + 100).astype(np.uint32)[:, None], m)
        row, noise = np.repeat(np.arange(at, at + 100), 5), np.tile(m - 1, 100)
        px, py = occupancy.placed(x[row], y[row], h.ravel(), reach, kind)
        plain.add(px, py, noise, g, 20, 1.5)
        left = quick.open(x[at:at + 100], y[at:at + 100], h, reach, kind)
        quick.add(px[left], py[left], noise[left])
        exact.append(len(left))
    assert (quick.table() == plain.table()).all()
    assert exact[0] == 500 and sum(exact[-5:]) < 1250


def test_no_draw_is_shuffled_or_joined(spark):
    df = spark.range(50).select(F.lit("p").alias("pair"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = gaps.bootstrap_counts(df, gaps.grid(df, 10, .05), 10, 5, 4, .05, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def flood(cells):
    left, label = set(cells), {}
    for c in sorted(cells, key=lambda c: (c[1], c[0])):
        if c in left:
            left.discard(c)
            todo = [c]
            while todo:
                i, j = todo.pop()
                label[i, j] = c
                for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
    return label


def test_tile_labels():
    rng = np.random.default_rng(2)
    spiral = [(i, j) for j in range(0, 16, 2) for i in range(16)] + [((15, 0)[j // 2 % 2], j) for j in range(1, 15, 2)]
    for cells in ([(3, 4)], spiral, *[[(int(i), int(j)) for i, j in np.argwhere(rng.random((16, 16)) < p)] for p in (.3, .55, .6, .9)]):
        want = flood(cells)
        code = np.array([j * gaps.ROW + i for i, j in cells])
        assert [(int(v % gaps.ROW), int(v // gaps.ROW)) for v in gaps.tile_labels(code, 16)] == [want[c] for c in cells]


@pytest.mark.parametrize("size,tile", [(40, 7), (40, 64), (3000, 128)])
def test_regions_across_tiles(spark, size, tile):
    """Labels of whole regions, numbered by their first cell; the fine grid has a sparse set of long lines and lone cells."""
    rng = np.random.default_rng(size + tile)
    if size < 100:
        cells = [(int(i), int(j)) for i, j in np.argwhere(rng.random((size, size)) < .58)]
    else:
        cells = {(int(i), int(j)) for i, j in rng.integers(0, size, (20_000, 2))}
        for k in range(0, size, 500):
            cells |= {(i, k) for i in range(size)} | ({(k, j) for j in range(size)} if k % 1000 else set())
        cells = sorted(cells)
    df = spark.createDataFrame([("a-b", i, j, float(i), float(j), .5 + (i % 3) / 10) for i, j in cells], "pair string, ix int, iy int, x double, y double, certainty double")
    got = gaps.label_regions(df, [.5, .6], tile).collect()
    for t in (.5, .6):
        own = [c for c in cells if .5 + (c[0] % 3) / 10 >= t]
        want = flood(own)
        number = {c: n for n, c in enumerate(sorted(set(want.values()), key=lambda c: (c[1], c[0])), 1)}
        assert {(r.ix, r.iy): r.gap_id for r in got if r.threshold == t} == {c: number[want[c]] for c in own}


def test_components_of_graphs(spark):
    rng = np.random.default_rng(9)
    edges = [(g, int(a), int(b)) for g in (1, 2) for a, b in rng.integers(0, 60, (35, 2))] + [(3, i, i + 1) for i in range(50)]
    got = {(r.g, r.node): r.root for r in components.components(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).collect()}
    for g in (1, 2, 3):
        own = [(a, b) for h, a, b in edges if h == g and a != b]
        root = {x: x for e in own for x in e}
        for _ in root:
            for a, b in own:
                root[a] = root[b] = min(root[a], root[b])
        assert {n: r for (h, n), r in got.items() if h == g} == root


@pytest.mark.parametrize("ends", [1, 4, 256])
def test_saturation_from_the_ends(spark, ends):
    """The same ranges whether few or all rows are looked at first."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 1)
    df = spark.createDataFrame([(i * 3, *map(float, r)) for i, r in enumerate(x)], "ID long, PC1 double, PC2 double, PC3 double")
    got = resample.saturation_runs(df.repartition(3), [5, 30], 20, ["PC1", "PC2", "PC3"], 2, ends=ends).collect()
    assert len(got) == 40
    drawn = {}
    for s in (5, 30):
        for r in resample.bootstrap(spark, 60, 20, s, 2, s).collect():
            drawn.setdefault((s, r.b), []).append(r.idx - 1)
    for r in got:
        size = np.ptp(x[drawn[r.sample_size, r.b]], axis=0)
        assert r.total_variance == pytest.approx(size.sum()) and r.pc1_variance == pytest.approx(size[0])
        assert r.cumulative_variance == pytest.approx(math.exp(np.log(np.where(size == 0, 1e-10, size)).mean()))


def test_moments_in_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 7)) * [1, 2, 3, 1e-3, 1e3, 1, 0] + 1e5
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(9)
    n, mean, cov = pca.moments(df, "v")
    assert n == 500 and mean == pytest.approx(x.mean(axis=0)) and np.allclose(cov, np.cov(x.T), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        pca.moments(df.where("v is null"), "v")


def test_hulls_in_lockstep():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 6, 40):
        x, y = np.round(rng.normal(size=(2, 80, n)), 1)
        if n > 3:
            x[:5], y[5:10] = 1.0, x[5:10]
        for a, u, v in zip(hull.hull_orders(x, y), x, y):
            assert a.tolist() == hull.hull_order(u, v).tolist()
        length, i, j = hull.longest_chords(x, y, hull.hull_orders(x, y))
        far = np.hypot(x[:, :, None] - x[:, None], y[:, :, None] - y[:, None])
        assert length == pytest.approx(far.max(axis=(1, 2))) and far[np.arange(80), i, j] == pytest.approx(length)
