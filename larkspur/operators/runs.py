"""Batch runs of per-row functions in which a failing row is a result, not the end of the job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that a run adds to those of its function.
MARKS = "error_code string, error_detail string, elapsed_ms double"


def isolated(run: Callable, returns: str, *columns: Column) -> Column:
    """struct of what `run` returns for each row, and `error_code`, `error_detail` and `elapsed_ms`.

    run: takes the columns' values and returns a value for each field of `returns` (DDL), as a tuple, or the only one as
    it is. Any exception of it becomes the row's error: the code is the exception's type, or its `code` where it has one,
    the detail `type: message`; the fields are null then. So does a result that has another number of fields. Values that
    don't fit their field's type are the function's to avoid. What ends the worker itself, such as running out of memory,
    still fails the task, which Spark repeats.
    """
    fields = T._parse_datatype_string(returns).names
    names = [*fields, "error_code", "error_detail", "elapsed_ms"]

    def one(values: tuple) -> tuple:
        began = time.perf_counter()
        try:
            got = run(*values)
            got = (got,) if len(fields) == 1 and not isinstance(got, tuple) else tuple(got)
            if len(got) != len(fields):
                raise ValueError(f"{len(got)} values for {len(fields)} fields")
            marks = (None, None)
        except Exception as e:  # noqa: BLE001: a failing row is data
            got = (None,) * len(fields)
            marks = (str(getattr(e, "code", None) or type(e).__name__), f"{type(e).__name__}: {e}")
        return (*got, *marks, 1000 * (time.perf_counter() - began))

    def batches_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for many in batches:
            rows = [one(values) for values in zip(*many, strict=True)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object if i < len(names) - 1 else "float64") for i, n in enumerate(names)})

    def series(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from batches_of((x,) for x in batches)

    # Batches of one column come as series, of several as tuples.
    return F.pandas_udf(series if len(columns) == 1 else batches_of, f"{returns}, {MARKS}")(*columns)


def run_cases(df: DataFrame, case: Sequence[str], run: Callable, inputs: Sequence[str], returns: str) -> DataFrame:
    """`case` columns, the fields of `returns`, error (struct code, detail; null where there is none) and elapsed_ms for every row of `df`."""
    fields = T._parse_datatype_string(returns).names
    got = df.select(*case, isolated(run, returns, *[F.col(c) for c in inputs]).alias("_r"))
    error = F.when(F.col("_r.error_code").isNotNull(), F.struct(F.col("_r.error_code").alias("code"), F.col("_r.error_detail").alias("detail")))
    return got.select(*case, *[F.col(f"_r.{f}").alias(f) for f in fields], error.alias("error"), F.col("_r.elapsed_ms").alias("elapsed_ms"))


def summary(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, error code (null for those without), how many cases, and their mean time: counts are pre-aggregated in each task."""
    return cases.groupBy(*by, F.col("error.code").alias("error_code")).agg(F.count("*").alias("cases"), F.avg("elapsed_ms").alias("mean_ms"))


def retried(cases: DataFrame, permanent: Sequence[str]) -> DataFrame:
    """Cases that a repeated run takes up again: those with an error whose code isn't in `permanent`, as a refusal is a result."""
    return cases.where(F.col("error").isNotNull() & ~F.col("error.code").isin(*permanent)) if permanent else cases.where("error is not null")
