"""Image jobs on image rows ``(img, height, width, v ARRAY<DOUBLE>)``.

One image is one row, so cropping, splitting, mirroring, completing, resizing
and distance maps are narrow steps without a shuffle: each batch of images is
sliced with numpy inside the task.  Morphs of neighbours move every image once, as
bytes; only morphs of chosen pairs join, image with image.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .joins import consecutive


def each_image(images: DataFrame, fn: Callable, keep: Sequence[str] = ("img",), names: Sequence[str] = ()) -> DataFrame:
    """Rows ``keep, names, height, width, v, status`` of ``fn(array, row)``.

    ``fn`` yields tuples (name values..., array) for one image; ``row`` has the
    other columns.  NULL or short pixel data is an unreadable image: it keeps
    one row without names and pixels.  A task holds one Arrow batch of input and
    about half a million pixels of output.
    """
    keep, names = list(keep), list(names)
    kinds = [images.schema[k] for k in keep] + [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType(kinds + [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
                                   T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType())])

    arrow, at = to_arrow_schema(schema), {c: i for i, c in enumerate(images.columns)}
    other = [c for c in images.columns if c != "v"]
    Row = namedtuple("Row", other, rename=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, v = Row(*[batch.column(at[c])[i].as_py() for c in other]), batch.column(at["v"])[i]
                named = dict(zip(other, row))
                kept, h, w = [named[k] for k in keep], named["height"], named["width"]
                if not v.is_valid or h is None or w is None or len(v) != h * w:
                    yield (*kept, *[None] * (len(names) + 3), "unreadable image")
                    continue
                a = v.values.to_numpy(zero_copy_only=False).astype(float).reshape(int(h), int(w))
                for *labels, b in fn(a, row):
                    yield (*kept, *labels, *b.shape, np.ascontiguousarray(b).ravel(), "ok")
    return images.mapInArrow(lambda b: _recorded(run(b), arrow, nan_is_null=True), schema)


def _nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scale by the nearest source pixel."""
    h, w = a.shape
    r = np.floor((np.arange(height) + 0.5) * h / height).astype(int)
    c = np.floor((np.arange(width) + 0.5) * w / width).astype(int)
    return a[np.ix_(r, c)]


def resize(images: DataFrame, width: int | None = None, height: int | None = None, padding: int = 0,
           background: float = 1.0) -> DataFrame:
    """Images scaled to a width or a height, the other side in proportion.

    ``padding`` adds a frame on all sides.  ``success`` and ``message`` tell
    unreadable images, which keep a row without pixels.
    """
    def scaled(a, _):
        h, w = a.shape
        if width is not None:
            size = (max(int(np.floor(h * width / w + 0.5)), 1), width)
        else:
            size = (height, max(int(np.floor(w * height / h + 0.5)), 1))
        yield (np.pad(_nearest(a, *size), padding, constant_values=background),)
    whole = F.when(F.coalesce(F.col("width") * F.col("height") > 0, F.lit(False)), F.col("v"))
    return each_image(images.withColumn("v", whole), scaled).drop("status").select(
        "*", F.col("v").isNotNull().alias("success"),
        F.when(F.col("v").isNotNull(), "converted").otherwise("unreadable image").alias("message"))


def half_crop(images: DataFrame, side: str = "right", offset_percent: float = 0.0) -> DataFrame:
    """Adds ``side``: the right half from width/2 - offset, the left from offset, or both."""
    def halves(a, _):
        w = a.shape[1]
        off, half = int(np.rint(w * offset_percent / 100)), w // 2
        for s in ("right", "left") if side == "both" else (side,):
            lo = max(half - off if s == "right" else off, 0)
            yield s, a[:, lo:min(lo + half, w)]
    return each_image(images, halves, names=["side"])


def split(images: DataFrame, positions: Sequence[float], direction: str = "vertical", mirror: str = "none") -> DataFrame:
    """Adds ``part``: pieces between cuts at shares of the width (vertical) or height.

    ``mirror`` flips the first, the second, both (all) or no piece across the
    direction of the split.
    """
    cuts = sorted({0.0, *map(float, positions), 1.0})
    axis = 1 if direction == "vertical" else 0
    first, last = ("left", "right") if axis else ("upper", "lower")
    n = len(cuts) - 1

    def pieces(a, _):
        px = [int(np.rint(c * a.shape[axis])) for c in cuts]
        for i in range(n):
            name = first if i == 0 else last if i == n - 1 else f"middle_{i}"
            b = a[:, px[i]:px[i + 1]] if axis else a[px[i]:px[i + 1]]
            turned = mirror == "both" or (mirror, i) in (("first", 0), ("second", 1))
            yield name, np.flip(b, axis) if turned else b
    return each_image(images, pieces, names=["part"])


def half_side(a: np.ndarray) -> str:
    """The half with the larger grey deviation; ties go right."""
    half = a.shape[1] // 2
    if half * a.shape[0] < 2:
        return "left"
    # rounded, so that equal halves tie whatever the summation order
    left, right = (round(float(p.std(ddof=1)), 9) for p in (a[:, :half], a[:, half:2 * half]))
    return "left" if left > right else "right"


def half_sides(images: DataFrame) -> DataFrame:
    """``img, side``."""
    return each_image(images, lambda a, _: [(half_side(a), a[:0])], names=["side"]).select("img", "side")


def complete(images: DataFrame, method: str = "mirror_right") -> DataFrame:
    """Double an image by its mirror copy on the left or the right.

    ``both_sides`` puts the copy opposite the half the image shows.
    """
    def doubled(a, _):
        left = method == "mirror_left" or (method == "both_sides" and half_side(a) == "right")
        m = a[:, ::-1]
        yield (np.hstack([m, a] if left else [a, m]),)
    return each_image(images, doubled)


def crop_to_content(images: DataFrame, background: float = 1.0) -> DataFrame:
    """Trim the uniform border; an image without content stays as it is."""
    def trimmed(a, _):
        r, c = np.nonzero(a != background)
        yield (a[r.min():r.max() + 1, c.min():c.max() + 1] if len(r) else a,)
    return each_image(images, trimmed)


def threshold_and_pad(images: DataFrame, threshold: float = 0.5, pad: int = 2) -> DataFrame:
    """Binary images; one whose border is not all white gets a white frame."""
    def framed(a, _):
        b = np.where(a > threshold, 1.0, 0.0)
        edge = min(b[0].min(), b[-1].min(), b[:, 0].min(), b[:, -1].min())
        yield (np.pad(b, pad, constant_values=1.0) if edge != 1 else b,)
    return each_image(images, framed)


def binary_check(images: DataFrame, limit: int = 10) -> DataFrame:
    """``img, n_values, binary``: more than ``limit`` distinct values is not binary."""
    n = F.size(F.array_distinct("v"))
    return images.select("img", n.alias("n_values"), (n <= limit).alias("binary"))


def standardise_size(images: DataFrame, width: int, height: int) -> DataFrame:
    """Resize every image to the given size (the first image's)."""
    return each_image(images, lambda a, _: [(_nearest(a, height, width),)])


# ---- morphs ------------------------------------------------------------------------------


def plan(images: DataFrame, mode: str, steps: int) -> DataFrame:
    """``a, b, step, alpha`` of a pair or a sequence of neighbours."""
    if mode not in ("pair", "sequence"):
        raise ValueError(f"unknown mode {mode}: choose pair or sequence, or give the pairs as a table")
    return consecutive(images.select("img"), "img", steps)


def _blended(planned: DataFrame, images: DataFrame, weight: Callable, gamma: float, threshold: float,
             weights: tuple[float, float] | None = None) -> DataFrame:
    """``a, b, step, height, width, v, status`` of blended, thresholded image pairs.

    The steps of a pair are taken after the join, so a pair of images meets
    once.  Images take the size of the first readable one; a pair with an
    unreadable image keeps its rows without pixels.
    """
    pairs = planned.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("step", "alpha"))).alias("_steps"))
    side = {k: images.select(F.col("img").alias(k), F.col("height").alias(f"h{k}"), F.col("width").alias(f"w{k}"),
                             F.col("v").alias(f"v{k}")) for k in "ab"}
    j = pairs.join(side["a"], "a").join(side["b"], "b")
    readable = images.filter("height > 0 and width > 0 and size(v) = height * width")
    size = readable.agg(F.min_by(F.struct("height", "width"), "img")).scalar()

    def grid(v, h, w, height, width):
        if v is None or pd.isna(h) or pd.isna(w) or len(v) != h * w or h * w == 0 or pd.isna(height):
            return None
        a = np.asarray(v, float).reshape(int(h), int(w))
        return a.ravel() if a.shape == (height, width) else _nearest(a, int(height), int(width)).ravel()

    @F.pandas_udf("array<double>")
    def mix(p: pd.Series, q: pd.Series, u: pd.Series, w: pd.Series, shapes: pd.DataFrame) -> pd.Series:
        out = []
        for m, n, s, t, k in zip(p, q, u, w, shapes.itertuples(index=False)):
            m, n = grid(m, k.ha, k.wa, k.height, k.width), grid(n, k.hb, k.wb, k.height, k.width)
            if m is None or n is None:
                out.append(None)
                continue
            z = s * m + t * n
            out.append(((z ** gamma if gamma != 1.0 else z) > threshold).astype(float))
        return pd.Series(out, dtype=object)
    one = j.withColumn("_s", F.explode("_steps")).withColumn("_t", size)
    shapes = F.struct("ha", "wa", "hb", "wb", F.col("_t.height").alias("height"), F.col("_t.width").alias("width"))
    w = weight(F.col("_s.alpha"))
    wa, wb = (F.lit(float(weights[0])), F.lit(float(weights[1]))) if weights else (1 - w, w)
    return one.select("a", "b", "_s.step", "_t.height", "_t.width", mix("va", "vb", wa, wb, shapes).alias("v")).select(
        "*", F.when(F.col("v").isNull(), "unreadable image").otherwise("ok").alias("status"))


def _packed(v: np.ndarray) -> bytes:
    """Pixels as bytes: one a pixel if all are multiples of 1/255 in [0, 1], else eight."""
    if v.size and np.isfinite(v).all() and v.min() >= 0 and v.max() <= 1:
        level = np.rint(v * 255)
        if (level / 255 == v).all():
            return level.astype(np.uint8).tobytes()
    return v.astype("<f8").tobytes()


def _unpacked(raw: bytes, pixels: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8) / 255 if len(raw) == pixels else np.frombuffer(raw, "<f8")


def _recorded(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 19, nan_is_null: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``size`` pixels."""
    held: list[tuple] = []
    pixels = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type, from_pandas=nan_is_null) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        pixels += max((len(x) for x in row if isinstance(x, (bytes, np.ndarray))), default=0) + 64
        if pixels > size:
            yield batch()
            held, pixels = [], 0
    if held:
        yield batch()


def _sequence(images: DataFrame, steps: int, weight: Callable, gamma: float, threshold: float,
              weights: tuple[float, float] | None = None) -> DataFrame:
    """:func:`_blended` of every image with the next one by name, without a join.

    Names alone give the bounds of ranges. Images move once, as bytes, to the task of their range, and the first image of a range also to
    the range before, so every pair of neighbours meets in one task, which holds two images at a time.
    """
    spark, kind = images.sparkSession, images.schema["img"].dataType
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = images.select("img").filter(F.col("img").isNotNull())
    sample = sorted(r[0] for r in names.orderBy(F.xxhash64("img"), "img").limit(32 * ranges).collect())
    # a bound is an image: the first one of its range
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    readable = images.filter("height > 0 and width > 0 and size(v) = height * width")
    size = readable.agg(F.min_by(F.struct("height", "width"), "img").alias("s")).first().s
    moved = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("img", kind), T.StructField("height", T.IntegerType()),
                          T.StructField("width", T.IntegerType()), T.StructField("raw", T.BinaryType())])
    arrow = to_arrow_schema(moved)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(b.num_rows):
                img, h, w, v = (b.column(c)[at] for c in range(4))
                h, w, name = h.as_py(), w.as_py(), img.as_py()
                pixels = None if not v.is_valid or not h or not w or len(v) != h * w else v.values.to_numpy(zero_copy_only=False).astype(float)
                part = bisect_right(bounds, name)
                raw = None if pixels is None else _packed(pixels)
                for to in ((part, part - 1) if part and bounds[part - 1] == name else (part,)):
                    yield to, name, h, w, raw
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *[T.StructField(c, T.IntegerType()) for c in ("step", "height", "width")],
                        T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType())])
    blended = to_arrow_schema(out)
    alphas = [s / (steps + 1) for s in range(1, steps + 1)]
    shares = [weights or (1 - weight(x), weight(x)) for x in alphas]

    def grid(h, w, raw):
        if raw is None or size is None:
            return None
        a = _unpacked(raw, h * w).reshape(h, w)
        return a.ravel() if a.shape == (size.height, size.width) else _nearest(a, size.height, size.width).ravel()

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for b in batches:
            for part, img, h, w, raw in zip(*(b.column(c) for c in range(5))):
                now = (part.as_py(), img.as_py(), grid(h.as_py(), w.as_py(), raw.as_py()))
                if last is not None and last[0] == now[0]:
                    for step, (p, q) in enumerate(shares, 1):
                        v = None
                        if last[2] is not None and now[2] is not None:
                            z = p * last[2] + q * now[2]
                            v = ((z ** gamma if gamma != 1.0 else z) > threshold).astype(float)
                        yield last[1], now[1], step, size and size.height, size and size.width, v, "ok" if v is not None else "unreadable image"
                last = now
    dealt = images.filter(F.col("img").isNotNull()).select("img", F.col("height").cast("int"), F.col("width").cast("int"), F.col("v").cast("array<double>")).mapInArrow(lambda b: _recorded(deal(b), arrow), moved)
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "img").mapInArrow(lambda b: _recorded(blend(b), blended), out)


def _eased(method: str) -> Callable:
    return (lambda a: a * a * a * (a * (a * 6 - 15) + 10)) if method == "spline" else (lambda a: a)


def morph_sequence(images: DataFrame, steps: int, method: str = "linear", gamma: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """:func:`morph` of all neighbours by name."""
    return _sequence(images, steps, _eased(method), gamma, threshold)


def morph_distance_sequence(images: DataFrame, steps: int, gamma: float = 1.0, threshold: float = 0.5,
                            weights: tuple[float, float] | None = None, normalise: bool = True) -> DataFrame:
    """:func:`morph_distance` of all neighbours by name."""
    return _sequence(distance_transform(images, normalise), steps, _eased("linear"), gamma, threshold, weights)


def morph(planned: DataFrame, images: DataFrame, method: str = "linear", gamma: float = 1.0,
          threshold: float = 0.5) -> DataFrame:
    """Blend the pixels of two images, brought to one size; ``spline`` eases the step."""
    return _blended(planned, images, _eased(method), gamma, threshold)


def exact_distance(zero: np.ndarray) -> np.ndarray:
    """Distance of every cell to the nearest true cell, one axis at a time."""
    h, w = zero.shape
    if not zero.any():
        return np.full((h, w), float(np.hypot(h, w)))
    cols = np.arange(w)
    # steps to the nearest true cell in the same column, down and up
    gap = np.where(zero, 0.0, np.inf)
    for r in range(1, h):
        gap[r] = np.minimum(gap[r], gap[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        gap[r] = np.minimum(gap[r], gap[r + 1] + 1)
    across = (cols[:, None] - cols[None, :]) ** 2.0
    return np.sqrt(np.stack([(gap[r][None, :] ** 2 + across).min(axis=1) for r in range(h)]))


def distance_transform(images: DataFrame, normalise: bool = True) -> DataFrame:
    """Euclidean distance to the nearest 0 pixel, as a share of the largest."""
    def mapped(a, _):
        d = exact_distance(a == 0)
        yield (d / d.max() if normalise and d.max() > 0 else d,)
    return each_image(images, mapped)


def morph_distance(planned: DataFrame, images: DataFrame, gamma: float = 1.0, threshold: float = 0.5,
                   weights: tuple[float, float] | None = None, normalise: bool = True) -> DataFrame:
    """Blend distance maps instead of pixels."""
    return _blended(planned, distance_transform(images, normalise), lambda a: a, gamma, threshold, weights)
