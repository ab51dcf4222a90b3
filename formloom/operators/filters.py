"""Row filters, validation reports and group labelling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outline as O
from ..sources.text import pc_columns


def _test(df: DataFrame, col: str, op: str, value=None) -> Column:
    c, text = F.col(col), F.col(col).cast("string")
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    compare = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b,
               "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}
    if op in compare:
        # a text that is no number compares as NULL, which drops the row
        return compare[op](c.try_cast("double") if is_text else c, F.lit(str(value)).try_cast("double"))
    if op in ("eq", "ne"):
        wanted = F.lit(value)
        if is_text:
            wanted = F.lit(str(value))
        elif isinstance(value, str) and isinstance(df.schema[col].dataType, T.NumericType):
            wanted = F.lit(value).try_cast("double")
        return c == wanted if op == "eq" else c != wanted
    return {"contains": lambda: text.contains(F.lit(value)),
            "starts": lambda: text.rlike(f"^{value}"), "ends": lambda: text.rlike(f"{value}$"),
            "is_na": c.isNull, "not_na": c.isNotNull}[op]()


def apply_filters(df: DataFrame, filters: Sequence[tuple]) -> DataFrame:
    """All of ``(column, op[, value])``; a NULL test drops the row.

    Ops: eq ne gt lt ge le contains starts ends is_na not_na.  Text is compared
    as a number by gt, ge, lt, le and as text by eq, ne.  One conjunction, so
    simple comparisons reach the scan.
    """
    return df.filter(reduce(lambda a, b: a & b, [_test(df, *f) for f in filters])) if filters else df


def require_rows(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """Raise unless ``df`` has at least ``n`` rows (reads at most n)."""
    if df.limit(n).count() < n:
        raise ValueError(f"at least {n} {what} are needed")
    return df


def finite_rows(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Rows with finite coordinates and, if named, a group."""
    keep = O.finite(F.col(x)) & O.finite(F.col(y))
    return df.filter(keep & F.col(group).isNotNull() if group else keep)


def complete_cases(df: DataFrame, cols: Sequence[str], group: str | None = None,
                   groups: Sequence | None = None) -> DataFrame:
    """No NULL or NaN in ``cols`` and, if given, only the listed groups."""
    out = df.dropna(subset=list(cols))
    if groups is not None:
        out = keep_groups(out, group, groups)
    return out


def keep_groups(df: DataFrame, group: str, groups: Sequence | DataFrame | None = None) -> DataFrame:
    """Rows of known groups; ``groups`` is a short list or a one-column table."""
    out = df.filter(F.col(group).isNotNull())
    if groups is None:
        return out
    if isinstance(groups, DataFrame):
        return out.join(groups.withColumnRenamed(groups.columns[0], group), group, "left_semi")
    return out.filter(F.col(group).isin(*groups))


def select_pcs(df: DataFrame, max_pcs: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *pc_columns(df.columns, max_pcs))


def compose_group(df: DataFrame, cols: Sequence[str], out: str = "group") -> DataFrame:
    """Paste several columns with ``_``; a missing part reads ``NA``."""
    return df.withColumn(out, F.concat_ws("_", *[
        F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]))


def shape_problems(outlines: DataFrame) -> DataFrame:
    """Ids whose outline misses a coordinate."""
    return outlines.filter(~O.is_shape(F.col("coo"))).select("id")


def integrity_report(outlines: DataFrame) -> DataFrame:
    """One row: shapes, factor rows, landmark consistency."""
    return outlines.agg(
        F.count("*").alias("n_shapes"),
        F.count_if(F.col("coo").isNotNull()).alias("n_coo"),
        (F.count_distinct(F.size("ldk")) <= 1).alias("same_landmark_count"),
        F.coalesce(F.bool_and(F.array_max("ldk") <= F.size("coo")), F.lit(True)).alias("landmarks_in_range"),
        F.count_if(~O.is_shape(F.col("coo"))).alias("bad_shapes"))


def verify(outlines: DataFrame) -> DataFrame:
    """The table itself when the report is clean, an error otherwise."""
    r = integrity_report(outlines).first()
    if not (r.same_landmark_count and r.landmarks_in_range and r.n_coo == r.n_shapes and r.bad_shapes == 0):
        raise ValueError(f"inconsistent outline table: {r.asDict()}")
    return outlines


def label_by_list(df: DataFrame, id_col: str, rules: Sequence[tuple[str, Sequence]], out: str,
                  default: str | None = None) -> DataFrame:
    """``rules`` = (label, ids) in order; later rules overwrite."""
    label = F.lit(default).cast("string")
    for name, ids in rules:
        label = F.when(F.col(id_col).cast("string").isin(*[str(i) for i in ids]), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def label_by_range(df: DataFrame, id_col: str, rules: Sequence[tuple[str, object, object]], out: str,
                   default: str | None = None, sort_ids: bool = True, order: str | None = None) -> DataFrame:
    """``rules`` = (label, start, end) over the order of the distinct ids.

    Membership in a range only needs comparisons, so no global ranking is
    built: sorted ids compare by value, ``first seen`` ids by the lowest value
    of ``order`` among their rows.  A rule with an unknown end is skipped; the
    ends may be swapped; later rules overwrite.
    """
    if sort_ids:
        keyed = df.withColumn("_k", F.col(id_col))
        position = lambda v: F.lit(v)
    else:
        first = df.groupBy(id_col).agg(F.min(order).alias("_k"))
        keyed = df.join(first, id_col)
        position = lambda v: first.filter(F.col(id_col) == F.lit(v)).select("_k").scalar()
    label = F.lit(default).cast("string")
    for name, a, b in rules:
        known = [df.filter(F.col(id_col) == F.lit(v)).limit(1).agg(F.count("*").alias("n")).scalar() > 0
                 for v in (a, b)]
        lo, hi = F.least(position(a), position(b)), F.greatest(position(a), position(b))
        label = F.when(known[0] & known[1] & F.col("_k").between(lo, hi), F.lit(name)).otherwise(label)
    return keyed.withColumn(out, label).drop("_k")
