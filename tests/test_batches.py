"""What a task holds in Python doesn't grow with the rows of a batch."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from formloom.functions import kernels
from formloom.operators import hull, kmeans, pixels


class Images:
    """Stands for a table of images and hands one batch to the task's function."""

    columns = ["img", "height", "width", "v"]
    schema = T.StructType([T.StructField("img", T.LongType()), T.StructField("height", T.IntegerType()),
                           T.StructField("width", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def __init__(self, images):
        rows = [(i, *(x.shape if x is not None else (2, 2)), None if x is None else x.ravel()) for i, x in enumerate(images)]
        self.batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=self.columns)

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_images_leave_a_task_in_small_batches():
    images = [np.full((32, 32), i % 2.0) for i in range(2000)] + [None]
    got = pixels.each_image(Images(images), lambda a, _: [("l", a), ("r", a[:, ::-1])], names=["part"])
    assert max(b.column("v").flatten().nbytes for b in got) < 8 << 20
    t = pa.Table.from_batches(got).to_pylist()
    assert [(r["img"], r["part"]) for r in t] == [(i, p) for i in range(2000) for p in "lr"] + [(2000, None)]
    assert t[3] == {"img": 1, "part": "r", "height": 32, "width": 32, "v": [1.0] * 1024, "status": "ok"} and t[-1]["status"] == "unreadable image"


def test_working_arrays_of_kernels_are_small():
    lengths = np.full(10_000, 64)
    parts = list(kernels._chunks(lengths, lambda n: 12 * (n + 1)))
    assert max(len(rows) * 12 * 65 for _, rows in parts) * 8 <= 1 << 20
    assert np.array_equal(np.concatenate([rows for _, rows in parts]), np.arange(10_000))


def test_hulls_take_a_batch_in_parts():
    x = pd.Series([np.arange(64.0)] * 10_000)
    parts = list(hull._by_length(x, x))
    assert max(u.nbytes for _, u, _ in parts) <= 1 << 20 and sum(len(p) for p, _, _ in parts) == 10_000


def test_sums_of_models_work_in_small_blocks():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(10_000, 2)), rng.normal(size=(25, 10, 2))
    centres[3, 4] = centres[3, 2]  # equal distances belong to the first
    tracemalloc.start()
    got = kmeans._sums(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    d = ((x[:, None, None] - centres[None]) ** 2).sum(axis=3)
    near = d.argmin(axis=2)
    for i in range(25):
        for j in range(10):
            own = x[near[:, i] == j]
            assert np.allclose(got[i, j, :4], [len(own), *own.sum(axis=0), (own * own).sum()])
        assert np.isclose(got[i, :, 4].sum(), d[:, i].min(axis=1).sum())
