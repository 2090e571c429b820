"""Pieces shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every operator: space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_left: list[tuple[SparkSession, str]] = []
#: The folder of sessions that name none.
_own: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII takes the fast built-in; other texts are translated."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Array of the words of a non-null text; empty for a text without words."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def hash128(c: Column) -> Column:
    """Two 64-bit hashes with different seeds, so that equal pairs mean equal texts for any corpus size met in practice."""
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))


def without(lines: str, gone: str) -> Column:
    """The lines at places that aren't in `gone`, joined again; linear in the lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.  Sessions without it (tests) get a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
            _left.append((spark, _own[0]))
        base = _own[0]
    path = f"{base}/tidemark-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def packed(df: DataFrame, rows: int, each: int = 500_000) -> DataFrame:
    """df, of `rows` narrow rows at most, in no more tasks than those need: a table of many tiny files costs more than its rows."""
    return df.coalesce(max(1, -(-rows // each)))


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def restored(docs: DataFrame, operator, *added: str) -> DataFrame:
    """What the operator leaves of docs, with the columns of docs: own ones named as those it adds stay, and n_chars follows the text."""
    own = {c: f"__tidemark_own_{c}" for c in docs.columns if c in added}
    out = operator(docs.withColumnsRenamed(own))
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def release(spark: SparkSession) -> None:
    """Lets the JVM find the shuffles of finished jobs, so that their files go now and not at some later collection.

    The last job's plan is held by threads that wait for the next event, so a job of one row goes before."""
    gc.collect()
    spark.range(1).collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote; only for tables that no later plan reads."""
    drop(df.sparkSession, df._scratch)


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone, and the folder is scratch
            return
