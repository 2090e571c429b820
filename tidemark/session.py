"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC timestamps, errors on overflow, names that keep case once folded, constants in ORDER BY and GROUP BY, exact decimals.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.orderByOrdinal": "false",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """A session of its own over the same context, with SETTINGS; the caller's session stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in SETTINGS.items():
        own.conf.set(k, v)
    return own


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    return configure(SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false").getOrCreate())
