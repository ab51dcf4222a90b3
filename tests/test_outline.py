import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import outline
from formloom.functions import efa as E
from formloom.functions import outline as O
from formloom.operators import shapes
from formloom.operators.hull import onion

C = lambda: F.col("coo")


def ring(n, a=1.0, b=1.0):
    return [(a * math.cos(2 * math.pi * k / n), b * math.sin(2 * math.pi * k / n)) for k in range(n)]


def one(df, col):
    return df.select(col.alias("v")).first().v


def test_regular_polygon(spark):
    d = outline(spark, ring(360))
    assert one(d, O.area(C())) == pytest.approx(180 * math.sin(2 * math.pi / 360))
    assert one(d, O.centroid_size(C())) == pytest.approx(1)


def test_open_perimeter(spark):
    assert one(outline(spark, [(0, 0), (3, 0), (3, 4)]), O.perimeter(C())) == pytest.approx(7)
    assert one(outline(spark, [(0, 0), (3, 0), (3, 4), (0, 0)]), O.perimeter(C())) == pytest.approx(12)


def test_rectangle(spark):
    d = shapes.descriptors(outline(spark, [(0, 0), (4, 0), (4, 3), (0, 3)])).first()
    assert (d.area, d.rectangularity, d.solidity, d.calliper) == pytest.approx((12, 1, 1, 5))


def test_star_is_not_convex(spark):
    pts = [((1 if k % 2 else 2) * math.cos(math.pi * k / 5), (1 if k % 2 else 2) * math.sin(math.pi * k / 5)) for k in range(10)]
    d = shapes.descriptors(outline(spark, pts), rectilinearity=True).first()
    assert d.solidity < 1 and d.convexity < 1


def test_ellipse_is_one_harmonic(spark):
    ef = E.with_forward(outline(spark, ring(360, 2, 1)), 8)
    p = one(ef, E.power(F.col("ef.harm")))
    assert p[0] / sum(p) > 0.99
    lw = one(outline(spark, ring(360, 2, 1)), O.length_width(C()))
    assert (lw.length, lw.width) == pytest.approx((4, 2), abs=1e-3)


def test_descriptors_ignore_position_turn_and_size(spark):
    base = outline(spark, [(0, 0), (4, 0), (5, 2), (3, 4), (-1, 3)])
    moved = base.withColumn("coo", O.scale(O.rotate(O.translate(C(), 3, -2), 0.7), 0.5))
    a, b = shapes.descriptors(base).first(), shapes.descriptors(moved).first()
    for c in ("circularity", "solidity", "eccentricityeigen", "rectangularity"):
        assert a[c] == pytest.approx(b[c])


def test_inverse_error_falls(spark):
    rng = np.random.default_rng(3)
    pts = [((1 + r) * x, (1 + r) * y) for (x, y), r in zip(ring(64), rng.normal(0, 0.1, 64))]
    ef = E.with_forward(outline(spark, pts), 24)
    errs = []
    for h in (2, 8, 24):
        back = E.with_inverse(ef, F.col("ef.harm"), F.col("ef.ao"), F.col("ef.co"), h, 256)
        near = O.with_nearest(back, C(), F.col("shape"))
        errs.append(sum(one(near, F.col("near.d"))))
    assert errs[0] > errs[1] > errs[2]


def test_harmonics_are_capped_over_the_set(spark):
    small, big = outline(spark, ring(12), 1), outline(spark, ring(40), 2)
    sizes = {r.id: len(r.coe) for r in E.efourier(small.unionByName(big), 10).collect()}
    assert sizes == {1: 20, 2: 20}


def test_mixed_lengths_in_one_batch(spark):
    both = outline(spark, ring(12), 1).unionByName(outline(spark, ring(40), 2)).coalesce(1)
    got = {r.id: [len(r.ef.harm), r.ef.harm[0].a] for r in E.with_forward(both, 10).collect()}
    assert got[1][0] == 6 and got[2][0] == 10
    assert got[2][1] == pytest.approx(one(E.with_forward(outline(spark, ring(40), 2), 10), F.col("ef.harm")[0]["a"]))


def test_slide_and_close(spark):
    d = outline(spark, ring(8))
    assert one(d, F.size(O.close(C()))) == 9
    assert one(d, O.is_closed(O.close(C())))
    assert one(d, O.slide(C(), 0) == C()) and one(d, O.slide(C(), 1) == C())
    assert one(d, O.at(O.slide(C(), 3), 1) == O.at(C(), 3))


def test_chain_code_rejects_jumps(spark):
    pix = spark.createDataFrame([([(0, 0), (2, 0)],)], "pix array<struct<x:int,y:int>>")
    with pytest.raises(Exception, match="one step"):
        pix.select(O.chain_code(F.col("pix"))).collect()


def test_onion_layers(spark):
    pts = ring(8) + [(0.5 * x, 0.5 * y) for x, y in ring(8)]
    layers = onion(outline(spark, pts)).groupBy("layer").count().orderBy("layer").collect()
    assert [(r.layer, r["count"]) for r in layers] == [(1, 9), (2, 9)]
