"""Column builders with the engine's value semantics.

Spark's own operators differ in NaN comparison, float division by zero, decimal scale and rounding, integer division,
letter case and time buckets; those are rebuilt here from built-in functions, so plans stay inside code generation.
"""

from __future__ import annotations

from decimal import ROUND_DOWN, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import SqlType

DAY_NS = 86_400_000_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checked(c: Column, t: SqlType) -> Column:
    """c in the Spark type of t; values outside an unsigned range raise."""
    low_high = t.range()
    if low_high is None:
        return c.cast(t.spark())
    low, high = low_high
    if t.name == "UINT64":
        low, high = F.lit(Decimal(low)), F.lit(Decimal(high))
    ok = c.isNull() | ((c >= low) & (c <= high))
    return F.when(ok, c).otherwise(F.raise_error(F.lit(f"out of range for {t.name}"))).cast(t.spark())


def truncated(c: Column, scale: int) -> Column:
    """Digits beyond the scale are dropped toward zero."""
    return F.when(c < 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale)))


def eq(a: Column, b: Column, t: SqlType) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b) if t.floating else a == b


def compare(op: str, a: Column, b: Column, t: SqlType) -> Column:
    """= <> < <= > >=.  With NaN on either side only <> is true; NULL gives NULL."""
    if op == "=":
        return eq(a, b, t)
    if op == "<>":
        return ~eq(a, b, t)
    plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return plain & ~F.isnan(a) & ~F.isnan(b) if t.floating else plain


def _whole(op: str, a: Column, b: Column, t: SqlType) -> Column:
    if op == "/":
        # integral division of Spark is bigint; UINT64 operands are decimals of scale 0
        out = truncated(a / b, 0) if t.name == "UINT64" else F.call_function("div", a, b)
    else:
        out = {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op]
    return checked(out, t)


def _float(op: str, a: Column, b: Column, t: SqlType) -> Column:
    if op == "/":
        out = F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
    elif op == "%":
        out = F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a % b)
    else:
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
    return out.cast(t.spark())


def _big(op: str, t: SqlType):
    """Decimal * and / whose exact intermediates pass 38 digits: Arrow batches through Python's decimals."""
    exact = Context(prec=120, rounding=ROUND_DOWN)
    step, top = Decimal(1).scaleb(-t.scale), Decimal(10) ** (t.precision - t.scale)

    @F.pandas_udf(T.DecimalType(t.precision, t.scale))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            v = exact.multiply(x, y) if op == "*" else exact.divide(x, y)
            v = v.quantize(step, rounding=ROUND_DOWN, context=exact)
            if abs(v) >= top:
                raise ArithmeticError(f"out of range for {t}")
            return v

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def _decimal(op: str, a: Column, b: Column, t: SqlType) -> Column:
    """Operands and result have one type; fractions beyond its scale are dropped toward zero."""
    spark, s = t.spark(), t.scale
    if op in ("+", "-", "%"):
        return {"+": a + b, "-": a - b, "%": a % b}[op].cast(spark)
    if t.precision + s > 38:
        return _big(op, t)(a, b)
    if op == "*":
        return truncated(a * b, s).cast(spark)
    wide = T.DecimalType(min(38, t.precision + s), s)
    q = truncated((a / b).cast(T.DecimalType(38, min(38, s + 2))), s).cast(wide)
    # the quotient was rounded once before it was cut; one step back where it came out too large
    ulp = F.lit(Decimal(1).scaleb(-s)).cast(wide)
    over = F.abs(q) * F.abs(b) > F.abs(a)
    return F.when(over, F.when(q < 0, q + ulp).otherwise(q - ulp)).otherwise(q).cast(spark)


def arithmetic(op: str, a: Column, b: Column, t: SqlType) -> Column:
    """+ - * / % on two operands of type t, with a result of type t."""
    a, b = a.cast(t.spark()), b.cast(t.spark())
    return (_float if t.floating else _decimal if t.name == "DECIMAL" else _whole)(op, a, b, t)


def negate(c: Column, t: SqlType) -> Column:
    return (-c).cast(t.spark())


def absolute(c: Column, t: SqlType) -> Column:
    return F.abs(c).cast(t.spark())


def _exact_decimal(t: SqlType):
    step, top = Decimal(1).scaleb(-t.scale), Decimal(10) ** (t.precision - t.scale)

    @F.pandas_udf(T.DecimalType(t.precision, t.scale))
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            d = Decimal(float(v))
            if not d.is_finite() or abs(d) >= top:
                raise ArithmeticError(f"out of range for {t}")
            return d.quantize(step, rounding=ROUND_DOWN, context=Context(prec=400))

        return pd.Series([one(v) for v in x], dtype=object)

    return lambda c: F.when(c.isNotNull(), run(F.coalesce(c, F.lit(0.0))))


def cast(c: Column, a: SqlType, b: SqlType) -> Column:
    """Explicit CAST between types that the binder lets through."""
    if a == b or a.text and b.text:
        return c
    if a.name == "DATE" and b.name == "TIMESTAMP_NS":
        return F.unix_date(c).cast("long") * F.lit(DAY_NS)
    if a.name == "TIMESTAMP_NS" and b.name == "DATE":
        return F.date_from_unix_date(((c - F.pmod(c, F.lit(DAY_NS))) / F.lit(DAY_NS)).cast("int"))
    if b.name == "DECIMAL":
        if a.floating:
            return _exact_decimal(b)(c.cast("double"))
        if a.name == "DECIMAL":
            return (truncated(c, b.scale) if b.scale < a.scale else c).cast(b.spark())
        return c.cast(b.spark())
    if b.integer and a.name == "DECIMAL":
        c = truncated(c, 0)
    if b.unsigned and a.floating:
        c = c.cast(T.DecimalType(38, 0)) if b.name == "UINT64" else c.cast("long")
    return checked(c, b)


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def upper(c: Column) -> Column:
    """a-z only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.upper(c)).otherwise(F.translate(c, _UPPER.lower(), _UPPER))


def time_bucket(width_ns: int, c: Column) -> Column:
    """Start of the half-open bucket, aligned to the Unix epoch; nanoseconds in and out."""
    return c - F.pmod(c, F.lit(width_ns).cast("long"))


def time_bucket_micros(width_us: int, c: Column) -> Column:
    """The same for a timestamp column without zone."""
    us = F.unix_micros(c.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(width_us).cast("long"))).cast("timestamp_ntz")


def nanos(c: Column) -> Column:
    """Nanoseconds of a microsecond timestamp."""
    return F.unix_micros(c.cast("timestamp")) * F.lit(1000)


def order(c: Column, descending: bool = False, nulls: str | None = None) -> Column:
    """NULLs last when ascending and first when descending, unless said otherwise."""
    first = nulls == "FIRST" if nulls else descending
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())
