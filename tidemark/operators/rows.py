"""LATEST BY, ordering, time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exprs import order


def time_range(df: DataFrame, column: str, start=None, end=None, open_start: bool = False, open_end: bool = True) -> DataFrame:
    """Rows with start <= time < end (sides open or closed as told); NULL times go.  Plain literals, so scans skip row groups."""
    c = F.col(column)
    if start is not None:
        df = df.where(c > start if open_start else c >= start)
    if end is not None:
        df = df.where(c < end if open_end else c <= end)
    return df.where(c.isNotNull()) if start is None and end is None else df


def latest_by(df: DataFrame, keys: list, at: Column, ties: list = ()) -> DataFrame:
    """One row per key tuple: the greatest time, then the greatest ties (NULL above all).  NULL keys form a group; a NULL time loses.

    row_number() = 1 lets Spark cut each map task's rows to one per key before the shuffle."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*map(col, keys)).orderBy(at.desc_nulls_last(), *[col(t).desc_nulls_first() for t in ties])
    return df.withColumn("__latest", F.row_number().over(w)).where(F.col("__latest") == 1).drop("__latest")


def ordered(df: DataFrame, keys: list[tuple], ties: list = ()) -> DataFrame:
    """keys: (column, descending, 'FIRST' | 'LAST' | None); ties make the order total."""
    return df.orderBy(*[order(c, d, n) for c, d, n in keys], *[order(F.col(t) if isinstance(t, str) else t) for t in ties])
