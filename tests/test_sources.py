"""Text formats, images and filters."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.operators import filters, joins, pixels
from formloom.sources import images, text


def test_outline_text(spark, tmp_path):
    (tmp_path / "one.txt").write_text("1 2\n3.5  4\n\n-1e1\t0\n")
    (tmp_path / "two.txt").write_text("0 0\n")
    got = {r.id: [tuple(p) for p in r.coo] for r in text.read_outlines(spark, str(tmp_path)).collect()}
    assert got == {"one": [(1, 2), (3.5, 4), (-10, 0)], "two": [(0, 0)]}


def test_tps(spark, tmp_path):
    (tmp_path / "a.tps").write_text(
        "LM=2\n1 2\n3 4\nCURVES=2\nPOINTS=2\n5 6\n7 8\nPOINTS=1\n9 10\nIMAGE=fish one.jpg\nID=7\nSCALE=0.25\n"
        "LM=1\n0 1\nID=second\n")
    (tmp_path / "b.tps").write_text("LM=0\nPOINTS=2\n1 1\n2 2\nLM=1\n3 3\n")
    rows = text.read_tps(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.specimen, r.part, r.part_no, r.seq)):
        got.setdefault((r.specimen, r.part, r.part_no), []).append((r.x, r.y))
    assert got == {("fish one", "landmark", 0): [(1, 2), (3, 4)], ("fish one", "curve", 1): [(5, 6), (7, 8)],
                   ("fish one", "curve", 2): [(9, 10)], ("second", "landmark", 0): [(0, 1)],
                   ("id1", "landmark", 0): [(1, 1), (2, 2)], ("id2", "landmark", 0): [(3, 3)]}
    assert {r.scale for r in rows if r.specimen == "fish one"} == {0.25}


def test_curves_and_landmarks(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("jaw0002 3 4\njaw0001 1 2\ntail0001 0 0\n")
    got = {(r.locus, r.specimen): [tuple(p) for p in r.coo] for r in text.read_curve_points(spark, str(tmp_path)).collect()}
    assert got == {("jaw", "s1"): [(1, 2), (3, 4)], ("tail", "s1"): [(0, 0)]}
    m = text.read_landmark_points(spark, str(tmp_path)).collect()
    assert {(r.specimen, r.name, r.x) for r in m} == {("s1", "jaw0002", 3.0), ("s1", "jaw0001", 1.0), ("s1", "tail0001", 0.0)}


def test_score_columns(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("ID,PC10,PC2,PCx,PC1\na,1,2,3,4\n")
    assert text.read_scores(spark, str(p)).columns == ["ID", "PC1", "PC2", "PC10"]
    p.write_text("ID,PC1\na,1\n")
    with pytest.raises(ValueError, match="two PC"):
        text.read_scores(spark, str(p))


def test_files_by_extension(spark, tmp_path):
    for n in ("a.jpg", "b.JPEG", "c.png"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpg").write_bytes(b"x")
    names = lambda **k: sorted(r.path.rsplit("/", 1)[1] for r in text.list_files(spark, str(tmp_path), **k).collect())
    assert names() == ["a.jpg", "b.JPEG", "d.jpg"]
    assert names(recursive=False) == ["a.jpg", "b.JPEG"]
    assert names(case_sensitive=True) == ["a.jpg", "d.jpg"]


def test_name_structure(spark):
    df = spark.createDataFrame([("a_b",), ("c_d",), ("e_f_g",)], "name string")
    assert [r.name for r in text.odd_names(df, "name").collect()] == ["e_f_g"]
    with pytest.raises(Exception, match="same name structure"):
        text.name_structure(df, "name", ["x", "y"]).collect()


def png(path, grey):
    h, w = grey.shape
    raw = b"".join(b"\0" + grey[r].tobytes() for r in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_to_outline(spark, tmp_path):
    a = np.full((12, 10), 255, np.uint8)
    a[3:8, 2:7] = 0
    png(tmp_path / "box.png", a)
    im = images.read_images(spark, str(tmp_path))
    r = im.first()
    assert (r.img, r.height, r.width) == ("box", 12, 10)
    coo = images.extract_outlines(im).first().coo
    pts = {tuple(p) for p in coo}
    assert len(coo) == len(pts) == 16
    assert {p[0] for p in pts} == set(range(3, 8)) and {p[1] for p in pts} == set(range(4, 9))
    top = images.extract_outlines(im, seed=lambda m: tuple(map(int, np.argwhere(m)[0]))).first().coo
    assert {tuple(p) for p in top} == pts


def test_trace_single_pixel_and_line():
    m = np.zeros((5, 5), bool)
    m[2, 2] = True
    assert images.trace(m, (2, 2)).tolist() == [[2, 2]]
    m[2, 1:4] = True
    assert {tuple(p) for p in images.trace(m, (2, 2))} == {(2, 1), (2, 2), (2, 3)}


def image(spark, a, key="x"):
    return spark.createDataFrame([(key, *a.shape, a.ravel().tolist())], "img string, height int, width int, v array<double>")


def grid(r):
    return np.array(r.v).reshape(r.height, r.width)


def test_distance_transform():
    zero = np.random.default_rng(8).random((9, 13)) < 0.15
    z = np.argwhere(zero)
    want = [[np.hypot(z[:, 0] - i, z[:, 1] - j).min() for j in range(13)] for i in range(9)]
    assert np.allclose(pixels.exact_distance(zero), want)


def test_frame_only_when_the_border_is_touched(spark):
    a = np.ones((6, 6))
    a[2:4, 2:4] = 0.2
    assert grid(pixels.threshold_and_pad(image(spark, a)).first()).shape == (6, 6)
    a[0, 3] = 0.4
    b = grid(pixels.threshold_and_pad(image(spark, a)).first())
    assert b.shape == (10, 10) and b[:2].min() == 1 and b[2, 5] == 0


def test_unreadable_image_keeps_a_row(spark):
    bad = spark.createDataFrame([("b", 3, 3, [1.0])], "img string, height int, width int, v array<double>")
    rows = {r.img: (r.success, r.message) for r in pixels.resize(image(spark, np.ones((4, 8))).unionByName(bad), width=4).collect()}
    assert rows == {"x": (True, "converted"), "b": (False, "unreadable image")}


def test_crop_complete_and_split(spark):
    a = np.ones((4, 6))
    a[1:3, 4] = 0
    im = image(spark, a)
    assert grid(pixels.crop_to_content(im).first()).shape == (2, 1)
    assert np.array_equal(grid(pixels.complete(im, "both_sides").first()), np.hstack([a[:, ::-1], a]))
    assert np.array_equal(grid(pixels.crop_to_content(image(spark, np.ones((2, 2)))).first()), np.ones((2, 2)))
    parts = {r.part: grid(r) for r in pixels.split(im, [0.5], "horizontal", "first").collect()}
    assert np.array_equal(parts["upper"], a[:2][::-1]) and np.array_equal(parts["lower"], a[2:])


def test_filters_and_guards(spark):
    df = spark.createDataFrame([("a1", "5"), ("b2", "x"), (None, "7")], "k string, v string")
    assert [r.k for r in filters.apply_filters(df, [("v", "gt", "4"), ("k", "not_na")]).collect()] == ["a1"]
    assert filters.apply_filters(df, [("k", "ne", "a1")]).count() == 1
    assert [r.v for r in filters.apply_filters(df, [("v", "ge", 5)]).collect()] == ["5", "7"]
    assert [r.v for r in filters.apply_filters(df, [("v", "eq", 5)]).collect()] == ["5"]
    assert filters.apply_filters(df, [("v", "lt", "x")]).count() == 0
    n = spark.createDataFrame([(5,), (6,)], "v int")
    assert filters.apply_filters(n, [("v", "eq", "5.0")]).count() == 1 and filters.apply_filters(n, [("v", "eq", "x")]).count() == 0
    with pytest.raises(ValueError, match="at least 4"):
        filters.require_rows(df, 4)
    with pytest.raises(ValueError, match="two levels"):
        joins.paired_groups(df, "k", "v", [])


def test_malformed_text_raises_or_is_null(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.txt").write_text("1 2\n3 4\n5 x\n")
    with pytest.raises(Exception, match="no coordinates in .*a.txt: 5 x"):
        text.read_outlines(spark, str(tmp_path / "o")).collect()
    tps = tmp_path / "t.tps"
    tps.write_text("LM=2\n1 2\n3 4\nIMAGE=FILM=7.jpg\nLM=1\n5 6\nID=second\nLM=1\n7 8\n")
    rows = text.read_tps(spark, str(tps)).orderBy("specimen", "seq").collect()
    assert [(r.specimen, r.x) for r in rows] == [("FILM=7", 1), ("FILM=7", 3), ("id1", 7), ("second", 5)]
    tps.write_text("LM=3\n1 2\n3 4\nID=a\n")
    with pytest.raises(Exception, match="fewer points than the header says in a"):
        text.read_tps(spark, str(tps)).collect()
    tps.write_text("LM=1\n1 2\n? ?\nID=a\n")
    with pytest.raises(Exception, match="no coordinates in a"):
        text.read_tps(spark, str(tps)).collect()
    (tmp_path / "s.csv").write_text("ID,PC1,PC2\na,NA,2\nb,1.5,x\n")
    assert [tuple(r) for r in text.read_scores(spark, str(tmp_path / "s.csv")).orderBy("ID").collect()] == [("a", None, 2.0), ("b", 1.5, None)]


def test_blank_and_short_images_keep_a_row(spark):
    kind = "img string, height int, width int, v array<double>"
    box = np.ones((6, 6))
    box[2:4, 2:4] = 0
    bad = spark.createDataFrame([("blank", 3, 3, [1.0] * 9), ("short", 3, 3, [1.0]), ("none", 2, 2, None)], kind)
    found = {r.img: (r.status, r.coo) for r in images.extract_outlines(image(spark, box).unionByName(bad)).collect()}
    assert found["x"][0] == "ok" and len(found["x"][1]) == 4
    assert {k: v for k, v in found.items() if k != "x"} == {"blank": ("no object", None), "short": ("unreadable image", None), "none": ("unreadable image", None)}
    assert images.extract_outlines(bad).count() == 3
    halves = pixels.half_crop(image(spark, box).unionByName(bad), "right").collect()
    assert sorted((r.img, r.status) for r in halves) == [("blank", "ok"), ("none", "unreadable image"), ("short", "unreadable image"), ("x", "ok")]


def test_morph_keeps_every_planned_pair(spark):
    im = image(spark, np.ones((4, 4)), "a").unionByName(image(spark, np.zeros((8, 2)), "b")).unionByName(image(spark, np.ones((4, 4)), "c"))
    im = im.unionByName(spark.createDataFrame([("d", 3, 3, [1.0])], "img string, height int, width int, v array<double>"))
    got = {(r.a, r.b): (r.status, r.height, r.width, r.v and len(r.v)) for r in pixels.morph(pixels.plan(im, "sequence", 1), im).collect()}
    assert got == {("a", "b"): ("ok", 4, 4, 16), ("b", "c"): ("ok", 4, 4, 16), ("c", "d"): ("unreadable image", 4, 4, None)}


def test_duplicate_stems_raise(spark):
    o = spark.createDataFrame([("s", 10, [(0.0, 0.0), (1.0, 1.0)])], "stem string, height int, coo array<struct<x:double,y:double>>")
    marks = spark.createDataFrame([("s", 1, 1.0, 9.0)], "stem string, seq int, x double, y double")
    assert joins.tie_landmarks(o, marks).first().ldk == [2]
    for a, b in ((o.unionAll(o), marks), (o, marks.unionAll(marks))):
        with pytest.raises(Exception, match="more than one outline"):
            joins.tie_landmarks(a, b).collect()


def test_nan_is_no_value_in_quantiles(spark):
    from formloom.operators.ranks import quantiles
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("nan"), None)], "v double")
    assert tuple(quantiles(df, [], "v", [0.5, 1.0], ["med", "top"]).first()) == (2.0, 3.0)


def test_lookup_takes_the_first(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0005, 0.0), (3, 1.0, 1.0)], "id int, x double, y double")
    ask = spark.createDataFrame([(0.0004, 0.0)], "x double, y double")
    assert joins.lookup_within(pts, ask, 0.001).first().found == 1


def test_median_and_which(spark):
    from formloom.functions import outline as O
    v = spark.createDataFrame([([3.0, 1.0, 1.0, 2.0],)], "v array<double>")
    r = v.select(O.median_of(F.col("v")).alias("m"), O.which_min(F.col("v")).alias("i"), O.which_max(F.col("v")).alias("j")).first()
    assert (r.m, r.i, r.j) == (1.5, 2, 1)


def test_bundles_round_trip(spark, tmp_path):
    """Many records in few files come back, also when a file is split in the middle of records."""
    o = spark.createDataFrame([(f"s {i}=x", [(i + k / 7, -k * 1e-5) for k in range(40)]) for i in range(300)], "id string, coo array<struct<x:double,y:double>>")
    text.write_bundles(text.outline_records(o).coalesce(2), str(tmp_path / "o"))
    assert len(list((tmp_path / "o").glob("part-*"))) == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r.id: r.coo for r in text.read_outlines(spark, str(tmp_path / "o"), bundled=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {r.id: r.coo for r in o.collect()}
    curves = spark.createDataFrame([(i, n, [(1.0, 2.0), (3.5, i * 1.0)]) for i in range(5) for n in ("a", "b")], "specimen int, locus string, coo array<struct<x:double,y:double>>")
    text.write_bundles(text.curve_records(curves), str(tmp_path / "c"))
    back = {(r.specimen, r.locus): r.coo for r in text.read_curve_points(spark, str(tmp_path / "c"), bundled=True).collect()}
    assert back == {(str(r.specimen), r.locus): r.coo for r in curves.collect()}
    marks = spark.createDataFrame([("p", "m1", 1.0, None), ("p", "m2", 2.0, 3.0), ("q", "m1", 0.0, 0.0)], "specimen string, name string, x double, y double")
    text.write_bundles(text.landmark_records(marks), str(tmp_path / "m"))
    assert sorted(map(tuple, text.read_landmark_points(spark, str(tmp_path / "m"), bundled=True).collect()), key=str) == sorted(map(tuple, marks.collect()), key=str)
    for bad in (("a\nb", "1 2"), ("a", "1 2\nID=c"), (None, "1 2")):
        with pytest.raises(Exception, match="a bundle cannot hold"):
            text.write_bundles(spark.createDataFrame([bad], "id string, value string"), str(tmp_path / f"bad{hash(bad)}"))


def test_odd_points_raise(spark, tmp_path):
    (tmp_path / "t.tps").write_text("LM=3\n1 2\n3 4\n5 6\n7 8\n9 1\nID=a\n")
    with pytest.raises(Exception, match="more points than the header says"):
        text.read_tps(spark, str(tmp_path / "t.tps")).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "s1.txt").write_text("arc0001 1 2\narc0002 3\n")
    with pytest.raises(Exception, match="no curve point in s1"):
        text.read_curve_points(spark, str(tmp_path / "c")).collect()


@pytest.mark.parametrize("kind", ["string", "long"])
def test_sequences_equal_planned_morphs(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for i in rng.permutation(40):
        h, w = (6, 5) if i % 3 else (4, 7)
        v = rng.integers(0, 2, h * w).astype(float) if i % 2 else rng.random(h * w)
        v = None if i in (11, 12) else v[:7].tolist() if i == 20 else v.tolist()
        rows.append((f"é{i:02d}" if kind == "string" else int(i) * 5, h, w, v))
    im = spark.createDataFrame(rows, f"img {kind}, height int, width int, v array<double>").repartition(5)

    def all_of(df):
        return {(r.a, r.b, r.step): (r.height, r.width, r.v, r.status) for r in df.collect()}
    plan = pixels.plan(im, "sequence", 2)
    assert len(all_of(pixels.morph_sequence(im, 2))) == 78
    for method, gamma in (("linear", 1.0), ("spline", 2.0)):
        assert all_of(pixels.morph_sequence(im, 2, method, gamma)) == all_of(pixels.morph(plan, im, method, gamma))
    assert all_of(pixels.morph_distance_sequence(im, 2, threshold=.2)) == all_of(pixels.morph_distance(plan, im, threshold=.2))
    assert pixels.morph_sequence(im.limit(0), 2).count() == 0
    assert "Join" not in pixels.morph_sequence(im, 2)._jdf.queryExecution().executedPlan().toString()


def test_outline_files_start_no_process_each(spark, tmp_path, monkeypatch):
    """The same files as Spark's own writer (odd, null and repeated ids too), without its start of a process for each file."""
    point = lambda x: [(float(x), 0.5)]
    rows = [("a b", point(1)), ("x/y=1%", point(2)), (None, point(3)), ("", []), ("twice", point(4)), ("twice", None), ("[é]{^}\n", point(5))]
    outlines = spark.createDataFrame(rows, "id string, coo array<struct<x:double,y:double>>").coalesce(1)
    text.outline_records(outlines).write.partitionBy("id").text(str(tmp_path / "spark"))
    text.write_outlines(outlines, "file://" + str(tmp_path / "own"))

    def files(name):
        return {str(p.parent.relative_to(tmp_path / name)): sorted(p.read_text().split("\n")) for p in (tmp_path / name).rglob("*.txt") if p.name[0] != "."}
    assert files("own") == files("spark")
    assert not list((tmp_path / "own").rglob("*.crc")) and (tmp_path / "own" / "_SUCCESS").exists()
    with pytest.raises(FileExistsError):
        text.write_outlines(outlines, str(tmp_path / "own"))
