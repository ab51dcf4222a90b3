"""Portable random draws.

A draw is a pure function of (seed, iteration, index): the first 8 hex digits
of an md5 as a fraction of 2^32.  A lost task recomputes the same numbers, and
any engine with md5 can reproduce them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import TWO_PI, double_array, let


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the given key parts."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    hexes = F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 8)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(4294967296.0)


def index(n, *parts) -> Column:
    """Uniform integer in 1..n."""
    return (F.floor(uniform(*parts) * n) + 1).cast("bigint")


def segments(*parts) -> list[Column]:
    """Four uniform draws from the four quarters of one md5."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    h = F.md5(F.concat_ws(":", *cols).cast("binary"))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(4)]


def box_muller(u: Column, v: Column) -> Column:
    """Standard normal from two uniform draws (0 is moved off the logarithm)."""
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(2.0 ** -33)))) * F.cos(F.lit(TWO_PI) * v)


# ---- draws from 32-bit integers ------------------------------------------------------
#
# Where one row is drawn thousands of times, its key is hashed once and every draw mixes small integers into it.
# The same numbers come from a column, from numpy and from SQL.

MASK = 0xFFFFFFFF
STEP = -1640531527  # these three, taken modulo 2 ** 32, are odd; negative ones keep a product inside 64 bits
FIRST, SECOND = -2048144789, -1028477387


def key(*parts) -> Column:
    """32 bits of the md5 of the given key parts, as a long."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 8), 16, 10).cast("long")


def mixed(h: Column, *values) -> Column:
    """The key ``h`` after mixing in each small integer in turn."""
    for v in values:
        v = (v if isinstance(v, Column) else F.lit(v)).cast("long")
        h = let((h + v * STEP).bitwiseAND(F.lit(MASK)), lambda x: x.bitwiseXOR(F.shiftright(x, 16)) * FIRST)
        h = let(h.bitwiseAND(F.lit(MASK)), lambda x: x.bitwiseXOR(F.shiftright(x, 13)) * SECOND)
        h = let(h.bitwiseAND(F.lit(MASK)), lambda x: x.bitwiseXOR(F.shiftright(x, 16)))
    return h


def mixed_np(h: np.ndarray, *values) -> np.ndarray:
    """:func:`mixed` over int64 arrays."""
    return mixed_32(np.asarray(h, np.int64).astype(np.uint32), *values).astype(np.int64)


def mixed_32(h: np.ndarray, *values) -> np.ndarray:
    """:func:`mixed` over unsigned 32-bit arrays, whose sums and products wrap as the masks do."""
    step, first, second = (np.array([c & MASK], np.uint32) for c in (STEP, FIRST, SECOND))
    for v in values:
        h = h + np.asarray(v, np.int64).astype(np.uint32) * step
        h ^= h >> 16
        h *= first
        h ^= h >> 13
        h *= second
        h ^= h >> 16
    return h


def poisson_steps(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... as far as a 32-bit draw can tell them apart from 1."""
    p = total = math.exp(-rate)
    out, k = [total], 0
    while total < 1 - 2.0 ** -33 and k < 10_000:
        k += 1
        p *= rate / k
        total += p
        out.append(total)
    return out


def copies(h: Column, b: Column, steps: list[float]) -> Column:
    """How often run ``b`` draws the row with key ``h``: a Poisson number from one draw."""
    u = mixed(h, b) / F.lit(4294967296.0)
    return let(u, lambda v: F.size(F.filter(double_array(steps), lambda s: s <= v)))
