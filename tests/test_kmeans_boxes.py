"""Boxes of rows that go to one centre as a whole."""

import numpy as np

from formloom.operators import kmeans


def test_boxes_give_the_sums_of_their_rows():
    rng = np.random.default_rng(3)
    for n, p, m, k in ((1, 2, 2, 1), (5, 2, 3, 3), (33, 1, 2, 2), (700, 3, 4, 6), (5000, 2, 5, 9)):
        x = kmeans._ordered(np.round(rng.normal(size=(n, p)), 1))  # equal rows and ties
        centres = x[rng.integers(0, n, (m, k))] + rng.normal(scale=.01, size=(m, k, p))
        got, want = kmeans._Tree(x).sums(centres), kmeans._sums(x, centres)
        assert (got[:, :, 0] == want[:, :, 0]).all() and np.allclose(got, want, atol=1e-8)


def test_rows_away_from_borders_are_not_looked_at():
    x = kmeans._ordered(np.random.default_rng(4).random((20_000, 2)))
    centres = np.array([[[.25, .5], [.75, .5]]])
    tree = kmeans._Tree(x)
    middle = tree.levels[-1][0]
    far = np.abs(middle[:, 0] - .5) > .1
    assert far.mean() > .7
    tree.rows[:, far] = tree.cells[:, far] = np.nan
    assert np.allclose(tree.sums(centres), kmeans._sums(x, centres))


def test_fit_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, .3, (1500, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, v.tolist() + (-v).tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    one = kmeans.fit_many(df, 2, [1, 3], nstart=3)
    monkeypatch.setattr(kmeans, "BLOCK", 2500)
    assert kmeans._dealt(df, 2).count() == 2 * 4
    some = kmeans.fit_many(df, 2, [1, 3], nstart=3)
    assert set(one) == set(some) == {(0, 1), (0, 3), (1, 1), (1, 3)}
    for key, fit in one.items():
        assert fit.n.sum() == 4500 and np.allclose(fit.centres, some[key].centres) and np.isclose(fit.cost, some[key].cost)
    assert sorted(one[0, 3].n) == [1500] * 3
