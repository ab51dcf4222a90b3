"""Images as rows and as pixel tables; outlines traced from masks.

``images(img, height, width, v ARRAY<DOUBLE>)`` holds grey values 0..1 in row
order; ``pixels(img, height, width, row, col, v)`` is the same, one row per
pixel, rows and columns counted from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import pt
from .text import stem

# eight neighbours, counter-clockwise from east, as (row, col) steps
RING = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``img, height, width, v`` of decodable image files (mean of the colours)."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [np.frombuffer(d, np.uint8).reshape(h * w, c)[:, :3].mean(axis=1) / 255
                 for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])]
            yield pd.DataFrame({"origin": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "v": v})
    out = raw.mapInPandas(grey, "origin string, height int, width int, v array<double>")
    return out.select(stem(F.col("origin")).alias("img"), "height", "width", "v")


def to_pixels(images: DataFrame) -> DataFrame:
    keep = [c for c in images.columns if c != "v"]
    return images.select(*keep, F.posexplode("v").alias("_p", "v")).select(
        *keep, F.floor(F.col("_p") / F.col("width")).cast("int").alias("row"),
        (F.col("_p") % F.col("width")).cast("int").alias("col"), "v")


def trace(mask: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Boundary pixels (row, col) of the object holding ``start``, in order.

    Moore neighbour walk from the object's lowest pixel under the start.
    """
    pad = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    pad[1:-1, 1:-1] = mask
    r, c = start[0] + 1, start[1] + 1
    while pad[r + 1, c]:
        r += 1
    first, out, came = (r, c), [(r, c)], 6
    first_move = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            nr, nc = r + RING[d][0], c + RING[d][1]
            if pad[nr, nc]:
                break
        else:
            break
        if (r, c) == first:
            if first_move is None:
                first_move = d
            elif d == first_move:
                out.pop()
                break
        r, c, came = nr, nc, (d + 4) % 8
        out.append((r, c))
    return np.array(out) - 1


def default_seed(mask: np.ndarray) -> tuple[int, int] | None:
    """The image centre, else the first object pixel from the centre row on."""
    h, w = mask.shape
    mid = (int(round(h / 2)) - 1, int(round(w / 2)) - 1)
    if mask[mid]:
        return mid
    pos = np.argwhere(mask)
    if not len(pos):
        return None
    below = pos[pos[:, 0] >= mid[0]]
    r, c = (below if len(below) else pos)[0]
    return int(r), int(c)


def extract_outlines(images: DataFrame, threshold: float = 0.5,
                     seed: Callable[[np.ndarray], tuple[int, int] | None] = default_seed) -> DataFrame:
    """``img, coo, status``: outline of the dark object of every image, y pointing up.

    ``seed(mask)`` may be any function giving a pixel inside the object.  An
    image without an object, or unreadable, keeps a row without ``coo``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for img, h, w, v in zip(pdf["img"], pdf["height"], pdf["width"], pdf["v"]):
                if v is None or pd.isna(h) or pd.isna(w) or len(v) != h * w or h * w == 0:
                    out.append((img, None, None, "unreadable image"))
                    continue
                mask = np.asarray(v, float).reshape(int(h), int(w)) <= threshold
                at = seed(mask) if mask.any() else None
                if at is None:
                    out.append((img, None, None, "no object"))
                    continue
                p = trace(mask, at)
                out.append((img, p[:, 1].astype(float) + 1, h - p[:, 0].astype(float) - 1, "ok"))
            yield pd.DataFrame(out, columns=["img", "x", "y", "status"], dtype=object)
    kind = images.schema["img"].dataType.simpleString()
    out = images.select("img", "height", "width", "v").mapInPandas(
        run, f"img {kind}, x array<double>, y array<double>, status string")
    return out.select("img", F.zip_with("x", "y", pt).alias("coo"), "status")
