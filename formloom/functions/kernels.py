"""Arrow-batched numpy kernels for work that is a product per outline.

Points x harmonics, points x points and candidate angles x edges cost far more
in interpreted array expressions than in one vectorised call per batch.
Everything linear in the outline stays in JVM expressions.  A kernel sees one
Arrow batch at a time and works through it in chunks of bounded size, so the
batch may mix outlines of any length.

Kernels read plain columns.  ``hold`` puts their input into a column that the
optimizer does not inline into the call: Spark does not find a Python function
whose argument holds nested lambdas, and would compute the argument per use.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 17  # cells of a working array: some hold eight of them, whatever the batch


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column computed exactly once per row (a narrow step)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def _chunks(lengths: np.ndarray, cost_per_row):
    """Row positions grouped by equal length, each group at most CHUNK cells."""
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        size = max(1, CHUNK // max(1, int(cost_per_row(int(n)))))
        for i in range(0, len(rows), size):
            yield int(n), rows[i:i + size]


def _stack(s: pd.Series, rows) -> np.ndarray:
    return np.stack([np.asarray(s.iat[i], float) for i in rows])


def _lengths(s: pd.Series) -> np.ndarray:
    return np.array([-1 if v is None else len(v) for v in s], int)


def fourier(x: Column, y: Column, nb_h: Column) -> Column:
    """Struct ``a, b, c, d`` (arrays), ``ao, co`` of open outlines."""
    @F.pandas_udf("a array<double>, b array<double>, c array<double>, d array<double>, ao double, co double")
    def run(x: pd.Series, y: pd.Series, nb_h: pd.Series) -> pd.DataFrame:
        size = _lengths(x)
        out = [None] * len(x)
        want = nb_h.to_numpy()
        for n, rows in _chunks(size, lambda n: (n + 1) * int(want.max(initial=1))):
            if n < 2:
                continue
            u, v = _stack(x, rows), _stack(y, rows)
            dx, dy = u - np.roll(u, 1, 1), v - np.roll(v, 1, 1)
            dt = np.maximum(np.hypot(dx, dy), 1e-10)
            t = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(dt, 1)], 1)
            total = t[:, -1:]
            h = np.arange(1, min(int(want[rows].max()), n // 2) + 1)
            angle = (2 * np.pi / total * t)[:, None, :] * h[None, :, None]
            dc, ds = np.diff(np.cos(angle), axis=2), np.diff(np.sin(angle), axis=2)
            k = total / (2 * np.pi ** 2 * h ** 2)
            parts = [k * np.einsum("rn,rhn->rh", g, w) for g in (dx / dt, dy / dt) for w in (dc, ds)]
            ao, co = 2 * (u * dt / total).sum(1), 2 * (v * dt / total).sum(1)
            for j, i in enumerate(rows):
                m = int(want[i])
                out[i] = (*[p[j, :m] for p in parts], ao[j], co[j])
        blank = (None,) * 6
        return pd.DataFrame([o or blank for o in out], columns=["a", "b", "c", "d", "ao", "co"])
    return run(x, y, nb_h)


def inverse_fourier(a: Column, b: Column, c: Column, d: Column, ao: Column, co: Column,
                    nb_pts: int) -> Column:
    """Struct ``x, y`` of arrays with ``nb_pts`` values."""
    @F.pandas_udf("x array<double>, y array<double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series,
            ao: pd.Series, co: pd.Series) -> pd.DataFrame:
        out = [(None, None)] * len(a)
        theta = 2 * np.pi * np.arange(nb_pts) / nb_pts
        for n, rows in _chunks(_lengths(a), lambda n: max(n, nb_pts)):
            if n < 0:
                continue
            ang = np.arange(1, n + 1)[:, None] * theta[None, :]
            ca, sa = np.cos(ang), np.sin(ang)
            x = ao.to_numpy()[rows, None] / 2 + (_stack(a, rows) @ ca + _stack(b, rows) @ sa if n else 0)
            y = co.to_numpy()[rows, None] / 2 + (_stack(c, rows) @ ca + _stack(d, rows) @ sa if n else 0)
            x, y = np.broadcast_to(x, (len(rows), nb_pts)), np.broadcast_to(y, (len(rows), nb_pts))
            for j, i in enumerate(rows):
                out[i] = (x[j], y[j])
        return pd.DataFrame(out, columns=["x", "y"])
    return run(a, b, c, d, ao, co)


def nearest(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """For each point of a the distance ``d`` to and index ``i`` of the nearest of b."""
    @F.pandas_udf("d array<double>, i array<int>")
    def run(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, r, s in zip(ax, ay, bx, by):
            p, q, r, s = (np.asarray(v, float) for v in (p, q, r, s))
            step = max(1, CHUNK // max(1, len(r)))
            ds, ids = [], []
            for k in range(0, len(p), step):
                m = np.hypot(p[k:k + step, None] - r[None, :], q[k:k + step, None] - s[None, :])
                pos = m.argmin(1)
                ds.append(m[np.arange(len(pos)), pos])
                ids.append(pos + 1)
            out.append((np.concatenate(ds) if ds else [], np.concatenate(ids) if ids else []))
        return pd.DataFrame(out, columns=["d", "i"])
    return run(ax, ay, bx, by)


def least_rotated_perimeter(lengths: Column, angles: Column, turns: Sequence[float]) -> Column:
    """Smallest sum of l(|cos(t+a)|+|sin(t+a)|) over the candidates a = |t - turn|."""
    @F.pandas_udf("double")
    def run(lengths: pd.Series, angles: pd.Series) -> pd.Series:
        out = []
        for l, t in zip(lengths, angles):
            l, t = np.asarray(l, float), np.asarray(t, float)
            cand = np.abs(t[None, :] - np.asarray(turns)[:, None]).ravel()
            step = max(1, CHUNK // max(1, len(t)))
            best = np.inf
            for k in range(0, len(cand), step):
                z = cand[k:k + step, None] + t[None, :]
                best = min(best, float(((np.abs(np.cos(z)) + np.abs(np.sin(z))) @ l).min()))
            out.append(best)
        return pd.Series(out)
    return run(lengths, angles)


def affine(v: Column, pre: np.ndarray, matrix: np.ndarray, post: np.ndarray) -> Column:
    """``(v - pre) @ matrix + post`` for an array column; NULL stays NULL.

    Vectors shorter than the matrix are padded with zeros (before ``pre``),
    longer ones are cut.
    """
    pre, matrix, post = (np.asarray(m, float) for m in (pre, matrix, post))

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        p, out = len(matrix), [None] * len(v)
        for n, rows in _chunks(_lengths(v), lambda n: max(matrix.shape)):
            if n < 0:
                continue
            m = np.zeros((len(rows), p))
            m[:, :min(n, p)] = _stack(v, rows)[:, :p]
            r = (m - pre) @ matrix + post
            for j, i in enumerate(rows):
                out[i] = r[j]
        return pd.Series(out)
    return run(v)


def equal_steps(x: Column, y: Column, n: Column) -> Column:
    """Struct ``x, y``: ``n`` points equally spaced along a closed polyline."""
    @F.pandas_udf("x array<double>, y array<double>")
    def run(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for u, v, k in zip(x, y, n):
            u, v = np.asarray(u, float), np.asarray(v, float)
            at = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(u), np.diff(v)))])
            want = at[-1] * np.arange(k) / k
            out.append((np.interp(want, at, u), np.interp(want, at, v)))
        return pd.DataFrame(out, columns=["x", "y"])
    return run(x, y, n)
