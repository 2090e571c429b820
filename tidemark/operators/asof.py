"""ASOF join: for each left row the last right row at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _key(c: Column, kind: str) -> Column:
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def asof_join(left: DataFrame, right: DataFrame, on: list[tuple], left_time: Column, right_time: Column, ties: list[Column] = (), how: str = "inner", slice_width: int | None = None, prefix: str = "") -> DataFrame:
    """Columns of left, then those of right (named prefix + name).

    on: pairs of (left, right) key columns; NULL and NaN keys and NULL times never match.  Of right rows at the same time
    the one with the greatest ties wins, NULL above all.  how: 'inner' or 'left'.

    Both sides are united and sorted by time within each key, and every left row takes the last right row before it:
    one shuffle of each side, linear after the sort, where a range join would be quadratic for each key.  With slice_width (in
    units of the times, which must then be numbers) a key's rows are dealt out by time slice as well, and rows that find nothing in their slice take the last
    right row of an earlier slice from a table of one row per key and slice: so a hot key isn't one task.
    """
    kinds_l, kinds_r = [left.select(a).dtypes[0][1] for a, _ in on], [right.select(b).dtypes[0][1] for _, b in on]
    n = len(on)
    lk = [_key(a, k).alias(f"__k{i}") for i, ((a, _), k) in enumerate(zip(on, kinds_l, strict=True))]
    rk = [_key(b, k).alias(f"__k{i}") for i, ((_, b), k) in enumerate(zip(on, kinds_r, strict=True))]
    keys = [f"__k{i}" for i in range(n)]
    rank = lambda t: F.struct(t.isNull().alias("n"), t.alias("v"))  # noqa: E731  NULL above all
    tie = F.struct(*[rank(t).alias(f"t{i}") for i, t in enumerate(ties)]) if ties else F.struct(F.lit(0).alias("t"))
    r = right.select(*rk, right_time.alias("__t"), tie.alias("__tie"), F.struct(*[F.col(f"`{c}`").alias(c) for c in right.columns]).alias("__r"))
    r = r.where(F.col("__t").isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    l = left.select(*lk, left_time.alias("__t"), F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns]).alias("__l"))  # noqa: E741
    both = r.select(*keys, "__t", F.lit(0).alias("__side"), "__tie", "__r", F.lit(None).cast(l.schema["__l"].dataType).alias("__l")).unionByName(
        l.select(*keys, "__t", F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), "__l")
    )
    part = list(keys)
    if slice_width:
        both = both.withColumn("__slice", F.floor(F.col("__t") / F.lit(slice_width)).cast("long"))
        part.append("__slice")
    w = Window.partitionBy(*part).orderBy(F.col("__t").asc_nulls_first(), "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("__r", ignorenulls=True).over(w)
    out = both.withColumn("__m", hit).where(F.col("__side") == 1)
    if slice_width:
        ends = r.withColumn("__slice", F.floor(F.col("__t") / F.lit(slice_width)).cast("long")).groupBy(*part).agg(F.max_by("__r", F.struct("__t", "__tie")).alias("__e"))
        slices = ends.select(*part, "__e").unionByName(l.select(*keys, F.floor(F.col("__t") / F.lit(slice_width)).cast("long").alias("__slice"), F.lit(None).cast(r.schema["__r"].dataType).alias("__e")).dropDuplicates(part))
        carry = slices.groupBy(*part).agg(F.first("__e", ignorenulls=True).alias("__e"))
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).where(F.col("__c").isNotNull()).select(*[F.col(p).alias(f"_{p}") for p in part], "__c")
        cond = F.lit(True)
        for p in part:
            cond = cond & (F.col(p) == F.col(f"_{p}"))
        out = out.join(carry, cond, "left").withColumn("__m", F.coalesce("__m", "__c"))
    # a left row without a key or time meets no right row
    none = F.col("__t").isNull()
    for k in keys:
        none = none | F.col(k).isNull()
    out = out.withColumn("__m", F.when(~none, F.col("__m")))
    if how == "inner":
        out = out.where(F.col("__m").isNotNull())
    return out.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(prefix + c) for c in right.columns])
