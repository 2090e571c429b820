"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, packed, saved


def _mark(edges: DataFrame) -> tuple:
    """Equal marks for equal link tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is the least node reachable.

    Links may repeat, point either way or join a node with itself; null ends are ignored.  Each round is
    two joins on nodes (hot nodes are split by AQE); rounds are written to the shared folder, so a lost executor
    costs one round.  No links or components pass through the driver, only a count and a checksum.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = saved(e)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, e = e, saved(packed(small, 2 * mark[0]))  # no round more than doubles the links
        was, mark = mark, _mark(e)
        forget(last)
        if mark == was:
            break
    top = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top.select("node", F.col("node").alias("component")))
