"""Aggregates with the engine's result types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import checked
from tidemark.functions.types import FLOAT64, INT64, SqlType

NAMES = ("count", "sum", "avg", "min", "max", "var_pop", "var_samp")


def result_type(name: str, t: SqlType | None) -> SqlType:
    return INT64 if name == "count" else FLOAT64 if name in ("avg", "var_pop", "var_samp") else t


def aggregate(name: str, c: Column | None, t: SqlType | None) -> Column:
    """SUM is exact and has its input's type: only a final value outside it is an error.  AVG and variances are over doubles."""
    if name == "count":
        return F.count(F.lit(1)) if c is None else F.count(c)
    if name == "sum":
        if t.name == "INT64":
            return checked(_wide_sum(c.cast("long")), t)
        if t.name in ("UINT64", "UINT32"):
            return checked(F.sum(c.cast("decimal(38,0)")), t)
        if t.integer:  # sums of narrower types stay within bigint
            return checked(F.sum(c.cast("long")), t)
        return F.sum(c).cast(t.spark())
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(c)
    return {"avg": F.avg, "var_pop": F.var_pop, "var_samp": F.var_samp}[name](c.cast("double"))


def _wide_sum(c: Column) -> Column:
    """Exact sum of bigints as decimal(38,0), from three sums of 21 or 22 bits each: these stay bigints for 2**41 rows, and
    cost no decimal for each row."""
    whole = lambda x: F.sum(x).cast("decimal(38,0)")
    low, middle, high = c.bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright(c, 22).bitwiseAND(F.lit((1 << 21) - 1)), F.shiftright(c, 43)
    power = lambda n: F.lit(str(1 << n)).cast("decimal(14,0)")
    return ((whole(high).cast("decimal(20,0)") * power(43)).cast("decimal(38,0)") + (whole(middle).cast("decimal(20,0)") * power(22)).cast("decimal(38,0)") + whole(low)).cast("decimal(38,0)")


def vwap(price: Column, size: Column) -> Column:
    """Weighted mean; NULL where the weights sum to zero."""
    return F.sum(price * size) / F.nullif(F.sum(size), F.lit(0.0))


def ohlc(value: Column, *at: Column) -> list[Column]:
    """open, high, low, close; first and last by the tuple of `at`."""
    key = F.struct(*at)
    return [F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close")]
