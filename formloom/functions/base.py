"""Small building blocks for array expressions.

``let`` binds an expression to a lambda variable.  Catalyst may inline a
projected column into a lambda body, where it would be evaluated once per
element; a lambda variable is evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
PI = 3.141592653589793


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body).getItem(0)


def lets(body, **values: Column) -> Column:
    """Like ``let`` for several names; ``body`` gets one struct variable."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def dbl(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def fsum(arr: Column, fn=lambda v: v) -> Column:
    """Sum of ``fn(element)`` over an array of any element type."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + fn(e))


def double_array(values) -> Column:
    """Literal ``array<double>`` built with one parser call."""
    if len(values) == 0:
        return F.expr("cast(array() as array<double>)")
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def div(a: Column, b: Column) -> Column:
    """``a / b`` as in IEEE arithmetic: a zero divisor gives an infinity or NaN.

    Plain division raises in ANSI mode, so one degenerate row would end a job.
    """
    a, b = a.cast("double"), b.cast("double")
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a * F.lit(float("inf"))))


def fmod(v: Column, m) -> Column:
    """Floor modulo for a positive modulus."""
    return F.pmod(v, dbl(m))


def r6(c: Column) -> Column:
    """Round to 6 decimals without negative zero (for compared results)."""
    return F.round(c, 6) + F.lit(0.0)


def zip_named(**arrays: Column) -> Column:
    """Zip two equally long arrays into structs with the given field names."""
    (na, a), (nb, b) = arrays.items()
    return F.zip_with(a, b, lambda u, v: F.struct(u.alias(na), v.alias(nb)))
