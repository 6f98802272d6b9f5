"""Row updates as new tables: a table and its changes give the next table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """`table` and the first of the new rows of each key that it hasn't got."""
    own = [c for c in rows.columns if c != order]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*own), order).alias("r")).select("r.*")
    return table.unionByName(first.join(table.select(*key), list(key), "left_anti").select(*table.columns))


def insert_or_replace(table: DataFrame, rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """`table` with the last of the new rows of each key in place of its own; whole rows, nothing is merged."""
    own = [c for c in rows.columns if c != order]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*own), order).alias("r")).select("r.*")
    return table.join(last.select(*key), list(key), "left_anti").unionByName(last.select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], rules: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the next table, rejected changes). changes: key, and for each column its value and `has_<column>`.

    A column changes only where it is given, also to null. rules: reason -> test over old columns and `new_<column>`;
    the first that a change fails rejects all of it.
    """
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], *[f"has_{c}" for c in columns], F.lit(True).alias("_given"))
    both = table.join(new, key, "left")
    reason = F.lit(None).cast("string")
    for why, test in reversed(list((rules or {}).items())):
        reason = F.when(F.col("_given") & ~F.coalesce(test, F.lit(True)), F.lit(why)).otherwise(reason)
    both = both.withColumn("reason", reason)
    takes = {c: F.coalesce(F.col(f"has_{c}"), F.lit(False)) & F.col("reason").isNull() for c in columns}
    out = both.select(*[F.when(takes[c], F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in table.columns])
    return out, both.where("reason is not null").select(key, "reason")


def set_once(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """`table` with `column` set from `values` where it is null; a set value stays."""
    new = values.groupBy(key).agg(F.min(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce(column, "_new")).select(*table.columns)


def current(rows: DataFrame, key: Sequence[str], attempt: str) -> DataFrame:
    """The latest attempt of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), attempt).alias("r")).select(*key, "r.*").select(*rows.columns)


def numbered(df: DataFrame, key: str, width: int, fmt: str, name: str) -> DataFrame:
    """`df` with ids from a format of the row's number (from 1) in the order of an integer key.

    Rows are numbered within ranges of `width` keys, each after the sum of the ranges before, so no task sees all rows.
    """
    ranged = df.withColumn("_r", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    base = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(key))
    return ranged.withColumn("_place", place).join(base, "_r").withColumn(name, F.format_string(fmt, F.col("_base") + F.col("_place"))).select(*df.columns, name)


def refuse_maps(df: DataFrame) -> DataFrame:
    """`df`, unless it holds a re-identification map anywhere, which must not be written with results."""

    def names(kind: T.DataType) -> set[str]:
        if isinstance(kind, T.StructType):
            return set(kind.names).union(*(names(f.dataType) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            return names(kind.elementType)
        if isinstance(kind, T.MapType):
            return names(kind.keyType) | names(kind.valueType)
        return set()

    if "reidentify_map" in names(df.schema):
        raise ValueError("a re-identification map must not be written")
    return df


def seed_if_empty(table: DataFrame, rows: DataFrame) -> DataFrame:
    """`table`, or `rows` where it has none; one row decides."""
    return rows.select(*table.columns) if table.isEmpty() else table


def reload(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every table of a schema replaced as a whole. Each is replaced at once; together they are not one transaction."""
    for name, rows in tables.items():
        refuse_maps(rows).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def append_log(rows: DataFrame, folder: str) -> None:
    """Rows appended to a log of JSON lines."""
    refuse_maps(rows).write.mode("append").json(folder)


def drift(settings: DataFrame, now: DataFrame, fixed: Sequence[str] = ()) -> DataFrame:
    """(key, was, is): settings (key, value) that a resumed run has otherwise than the first one; a fixed one is an error."""
    both = settings.select("key", F.col("value").alias("was")).join(now.select("key", F.col("value").alias("is")), "key", "full_outer")
    changed = both.where(~F.col("was").eqNullSafe(F.col("is")))
    wrong = F.raise_error(F.concat(F.lit("a resumed run must not change "), "key")).cast("string")
    return changed.withColumn("is", F.when(F.col("key").isin(*fixed), wrong).otherwise(F.col("is"))) if fixed else changed
