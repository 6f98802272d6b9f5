"""Filters, look-ups and pages over one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes.
DEFAULT_LIMIT, MOST_LIMIT = 50, 200


def search(df: DataFrame, equal: Mapping | None = None, contains: Mapping | None = None, between: Mapping | None = None) -> DataFrame:
    """Rows that meet every given filter; None means not given. Without any filter it is an error.

    contains matches regardless of case, with % and _ as wildcards. A bound of `between` may be None.
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.upper(c).like(f"%{v.upper()}%") for c, v in (contains or {}).items() if v is not None]
    for c, (low, high) in (between or {}).items():
        tests += [F.col(c) >= low] if low is not None else []
        tests += [F.col(c) <= high] if high is not None else []
    if not tests:
        raise ValueError("at least one filter is required")
    return df.where(reduce(Column.__and__, tests))


def within_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows of an inclusive window of ISO dates. The column itself is compared, so the filter reaches the scan."""
    kind = df.schema[column].dataType
    day = lambda x, more: F.date_add(F.lit(x).cast("date"), more).cast(kind)
    return df.where((F.col(column) >= day(first, 0)) & (F.col(column) < day(last, 1)))


def box(df: DataFrame, bounds: Mapping[str, tuple[float, float]], null_as: Mapping[str, float] | None = None) -> DataFrame:
    """Rows within all bounds, every one of which must be given; nulls count as `null_as`."""
    if any(low is None or high is None for low, high in bounds.values()):
        raise ValueError("every bound is required")
    null_as = null_as or {}
    own = {c: F.coalesce(F.col(c), F.lit(null_as[c])) if c in null_as else F.col(c) for c in bounds}
    return df.where(reduce(Column.__and__, [own[c].between(*b) for c, b in bounds.items()]))


def page_of(limit: object = None, offset: object = None, most: int = MOST_LIMIT) -> tuple[int, int]:
    """(limit, offset): bad or out-of-range values are passed over in silence."""

    def whole(x: object) -> int | None:
        try:
            return int(str(x))
        except ValueError:
            return None

    n, k = whole(limit), whole(offset)
    return (n if n is not None and 0 < n <= most else DEFAULT_LIMIT), (k if k is not None and k >= 0 else 0)


def page(df: DataFrame, *order: Column | str, limit: object = None, offset: object = None) -> DataFrame:
    """One page of `df` in order: a top-k, not a full sort."""
    n, k = page_of(limit, offset)
    out = df.orderBy(*order)
    return (out.offset(k) if k else out).limit(n)


def found(df: DataFrame, **key: object) -> DataFrame:
    """The row of a key; no row means not found."""
    return df.where(reduce(Column.__and__, [F.col(c) == v for c, v in key.items()]))


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """`parents` and, as an array of structs in order, their rows; an empty array without rows."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def mapped(value: Column, table: Mapping[str, str], empty: str, other: str) -> Column:
    """A code's name; an empty or null one is `empty`, an unknown one `other`."""
    out = F.when(F.coalesce(value, F.lit("")) == "", F.lit(empty))
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(other))


def without(df: DataFrame, *hidden: str) -> DataFrame:
    """`df` without columns that must not leave; a missing one is an error."""
    missing = set(hidden) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*hidden)
