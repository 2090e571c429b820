"""The driver's queries over its tables, each with the same question in ANSI SQL."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import exprs as X
from tidemark.functions.types import ColumnSpec, SqlType, TableSpec, decimal
from tidemark.operators.aggregates import ohlc, vwap
from tidemark.operators.asof import asof_join
from tidemark.operators.rows import latest_by, ordered, time_range
from tidemark.sources import interop
from tidemark.sources.store import VersionLog
from tidemark.streaming.view import View, ViewSpec, batch_view, stream_view

#: (key columns) of the driver's tables that order their rows.
_TABLES = {"events": ("ts", ("user_id", "ts"), ("event_id",)), "orders": ("o_orderdate", ("o_orderkey",), ("o_orderkey",)), "lineitem": ("l_shipdate", ("l_orderkey", "l_linenumber"), ())}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.register(t, e.spark.read.parquet(f"{sf_dir}/{t}.parquet"), *_TABLES[t])
    return e


#: name: (tables, statement of the dialect, the same for DuckDB)
STATEMENTS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "scan_wide": (("lineitem",), "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_discount >= 0.09",
        "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_ns(l_shipdate) AS l_shipdate FROM lineitem WHERE l_discount >= 0.09"),
    "scan_star": (("orders",), "SELECT * FROM orders WHERE o_totalprice > 400000.0",
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_ns(o_orderdate) AS o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 400000.0"),
    "filter_time_range": (("events",), "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00Z' AND ts < TIMESTAMP '2024-01-12 00:00:00.5Z'",
        "SELECT event_id, epoch_ns(ts) AS ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00.5'"),
    "filter_in_between": (("events",), "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id BETWEEN 10 AND 60 AND value IS NOT NULL AND event_type NOT IN ('view')",
        "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id BETWEEN 10 AND 60 AND value IS NOT NULL AND event_type NOT IN ('view')"),
    "filter_three_valued": (("events",), "SELECT event_id FROM events WHERE NOT (value > 50.0 OR CAST(NULL AS BOOL)) IS NULL",
        "SELECT event_id FROM events WHERE value > 50.0"),
    "project_text": (("events",), "SELECT event_id, upper(event_type) AS up, lower(upper(event_type)) AS low, coalesce(CAST(NULL AS STRING), event_type) AS kind FROM events",
        "SELECT event_id, upper(event_type) AS up, lower(event_type) AS low, event_type AS kind FROM events"),
    "project_arithmetic": (("events",), "SELECT event_id, -7 / 2 AS q, -7 % 3 AS r, (user_id - 50) / 7 AS d, (user_id - 50) % 7 AS m, abs(user_id - 50) AS a, value * 2.0 - 1.0 AS x, CAST(value AS INT64) AS whole FROM events",
        "SELECT event_id, CAST(-3 AS BIGINT) AS q, CAST(-1 AS BIGINT) AS r, CAST(trunc((user_id - 50) / 7.0) AS BIGINT) AS d, (user_id - 50) % 7 AS m, abs(user_id - 50) AS a, value * 2.0::DOUBLE - 1.0::DOUBLE AS x, CAST(trunc(value) AS BIGINT) AS whole FROM events"),
    "project_float_zero": (("events",), "SELECT event_id, value / 0.0 AS inf, (0.0 / 0.0) = (0.0 / 0.0) AS nan_eq, (0.0 / 0.0) <> value AS nan_ne FROM events WHERE value > 0.0",
        "SELECT event_id, 'infinity'::DOUBLE AS inf, false AS nan_eq, true AS nan_ne FROM events WHERE value > 0"),
    "project_decimal": (("lineitem",), "SELECT l_orderkey, CAST(CAST(CAST(l_quantity AS INT64) AS DECIMAL(12, 2)) / CAST(7 AS DECIMAL(12, 2)) AS FLOAT64) AS q FROM lineitem",
        "SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) * 100 // 7 AS DOUBLE) / 100 AS q FROM lineitem"),
    "project_dates": (("events",), "SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-05' AS fifth, CAST(CAST(ts AS DATE) AS TIMESTAMP_NS) AS midnight FROM events",
        "SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-05' AS fifth, epoch_ns(date_trunc('day', ts)) AS midnight FROM events"),
    "aggregate_global": (("lineitem",), "SELECT count(*) AS n, count(l_tax) AS n_tax, sum(l_partkey) AS s, avg(l_partkey) AS m, min(l_returnflag) AS lo, max(l_returnflag) AS hi, var_pop(l_partkey) AS vp, var_samp(l_partkey) AS vs FROM lineitem",
        "SELECT count(*) AS n, count(l_tax) AS n_tax, CAST(sum(l_partkey) AS BIGINT) AS s, avg(l_partkey) AS m, min(l_returnflag) AS lo, max(l_returnflag) AS hi, var_pop(l_partkey) AS vp, var_samp(l_partkey) AS vs FROM lineitem"),
    "aggregate_grouped": (("lineitem",), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_shipdate) AS ship_from, max(l_shipdate) AS ship_to, max(l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, epoch_ns(min(l_shipdate)) AS ship_from, epoch_ns(max(l_shipdate)) AS ship_to, max(l_linenumber) AS lines FROM lineitem GROUP BY ALL"),
    "aggregate_expression_keys": (("events",), "SELECT user_id % 10 AS k, time_bucket(INTERVAL '7 days', ts) AS w, count(*) AS n, sum(user_id + 1) AS s FROM events GROUP BY user_id % 10, time_bucket(INTERVAL '7 days', ts)",
        "SELECT user_id % 10 AS k, epoch_ns(ts) - epoch_ns(ts) % 604800000000000 AS w, count(*) AS n, CAST(sum(user_id + 1) AS BIGINT) AS s FROM events GROUP BY ALL"),
    "aggregate_arithmetic": (("lineitem",), "SELECT l_returnflag, sum(l_orderkey * 2) / count(*) AS ratio, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(l_orderkey * 2) // count(*) AS BIGINT) AS ratio, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag"),
    "aggregate_empty": (("events",), "SELECT count(*) AS n, sum(user_id) AS s, max(event_type) AS m FROM events WHERE event_id < 0",
        "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s, max(event_type) AS m FROM events WHERE event_id < 0"),
    "aggregate_order_only": (("events",), "SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC LIMIT 3",
        "SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3"),
    "aggregate_high_cardinality": (("lineitem",), "SELECT l_orderkey, count(*) AS n, sum(l_partkey) AS s FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey"),
    "bucket_minute": (("events",), "SELECT time_bucket(INTERVAL '1 minute', ts) AS b, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL '1 minute', ts)",
        "SELECT epoch_ns(date_trunc('minute', ts)) AS b, count(*) AS n FROM events GROUP BY ALL"),
    "bucket_hour": (("events",), "SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts), event_type",
        "SELECT epoch_ns(date_trunc('hour', ts)) AS b, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL"),
    "bucket_day": (("events",), "SELECT time_bucket(INTERVAL '1 day', ts) AS b, count(*) AS n, min(user_id) AS u FROM events GROUP BY time_bucket(INTERVAL '1 day', ts)",
        "SELECT epoch_ns(date_trunc('day', ts)) AS b, count(*) AS n, min(user_id) AS u FROM events GROUP BY ALL"),
    "latest_user": (("events",), "SELECT user_id, ts, event_id, value FROM events LATEST BY (user_id) ON ts",
        "SELECT user_id, epoch_ns(ts) AS ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1"),
    "latest_user_type": (("events",), "SELECT user_id, event_type, event_id FROM events LATEST BY (user_id, event_type) ON ts",
        "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1"),
    "latest_then_where": (("events",), "SELECT user_id, event_id FROM events LATEST BY (user_id) ON ts WHERE event_type = 'click'",
        "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND event_type = 'click'"),
    "latest_then_group": (("events",), "SELECT event_type, count(*) AS n FROM events LATEST BY (user_id) ON ts GROUP BY event_type",
        "SELECT event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type"),
    "asof_inner": (("events",), "SELECT l.event_id AS id, r.event_id AS prior FROM events AS l ASOF JOIN events AS r ON l.user_id = r.user_id AND r.ts <= l.ts WHERE l.event_type = 'click'",
        "SELECT event_id AS id, event_id AS prior FROM events WHERE event_type = 'click'"),
    "order_nulls_limit": (("events",), "SELECT event_id, user_id, ts FROM events ORDER BY user_id DESC NULLS LAST, ts LIMIT 50",
        "SELECT event_id, user_id, epoch_ns(ts) AS ts FROM events ORDER BY user_id DESC NULLS LAST, ts LIMIT 50"),
    "order_alias_expression": (("events",), "SELECT event_id, value * -1.0 AS neg FROM events ORDER BY neg ASC NULLS FIRST, event_id LIMIT 20",
        "SELECT event_id, value * -1.0::DOUBLE AS neg FROM events ORDER BY neg ASC NULLS FIRST, event_id LIMIT 20"),
    "limit_zero": (("events",), "SELECT event_id FROM events LIMIT 0", "SELECT event_id FROM events LIMIT 0"),
}


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, sql, _ = STATEMENTS[name]
    return lambda spark, sf_dir: engine(spark, sf_dir, *tables).sql(sql)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def asof_left(spark: SparkSession, sf_dir: str, how: str = "left", slice_width: int | None = None) -> DataFrame:
    """Each click with the user's last view before it."""
    e = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    l = e.where("event_type = 'click'").select("event_id", "user_id", "us")  # noqa: E741
    r = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("us").alias("t"))
    out = asof_join(l, r, [(F.col("user_id"), F.col("u"))], F.col("us"), F.col("t"), [F.col("view_id")], how, slice_width)
    return out.select("event_id", "user_id", "view_id")


def asof_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last view and last purchase, both optional."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    out = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    for kind in ("view", "purchase"):
        r = e.where(F.col("event_type") == kind).select(F.col("event_id").alias(kind), F.col("user_id").alias(f"u_{kind}"), F.col("ts").alias(f"t_{kind}"))
        out = asof_join(out, r, [(F.col("user_id"), F.col(f"u_{kind}"))], F.col("ts"), F.col(f"t_{kind}"), [F.col(kind)], "left")
    return out.select("event_id", "view", "purchase")


def asof_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_left(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("clicks"), F.count("view_id").alias("after_view"))


def asof_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_left(spark, sf_dir).where("view_id is null").select("event_id")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close of values by type and day."""
    e = _events(spark, sf_dir).withColumn("b", X.time_bucket_micros(86_400_000_000, F.col("ts")))
    return e.groupBy("event_type", "b").agg(*ohlc(F.col("value"), F.col("ts"), F.col("event_id")))


def weighted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price weighted by quantity, by return flag and status."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(vwap(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("vwap"), F.count("*").alias("n"))


def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and tops by type over one day."""
    e = time_range(_events(spark, sf_dir), "ts", F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(_events(spark, sf_dir).where("event_type = 'purchase'"), ["user_id"], F.col("ts"), ["event_id"]).select("user_id", "event_id")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(_events(spark, sf_dir).select("event_id", "value"), [(F.col("value"), True, "LAST")], ["event_id"]).limit(100)


def _windows(spark: SparkSession, sf_dir: str, width: int, slide: int) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("grp"), F.col("event_id").cast("string").alias("identity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("ord"), "value", F.col("user_id").cast("double").alias("weight"))
    return batch_view(rows, ViewSpec(width, slide)).select("grp", "window_start", "n", "least", "greatest", "open", "close")


def view_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 3_600_000_000, 3_600_000_000)


def view_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 86_400_000_000, 21_600_000_000)


def _work(spark: SparkSession) -> str:
    """A folder that all executors see; local where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/store-{uuid.uuid4().hex}"


_LOG = TableSpec("history", (ColumnSpec("ts", SqlType("TIMESTAMP_NS"), False), ColumnSpec("event_id", SqlType("INT64"), False), ColumnSpec("user_id", SqlType("INT64")), ColumnSpec("value", SqlType("FLOAT64"))), "ts", ("event_id",), ("event_id",), ("event_id",), 30 * 86_400_000_000_000)


def history(spark: SparkSession, sf_dir: str) -> VersionLog:
    """events as originals at time 1000, corrections of every seventh at 2000, and every eleventh deleted at 3000."""
    e = Engine(spark, _work(spark))
    log = e.create(_LOG)
    rows = e.spark.read.parquet(f"{sf_dir}/events.parquet").select(X.nanos(F.col("ts")).alias("ts"), "event_id", "user_id", "value")
    log.append(rows, "loader", "first", 1000)
    log.apply(rows.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1000).withColumn("_op", F.lit("correction")), 2000)
    log.apply(rows.where("event_id % 11 = 0").withColumn("_op", F.lit("tombstone")), 3000)
    return log


def _seen(df: DataFrame) -> DataFrame:
    return df.select("event_id", "user_id", "value")


def history_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(history(spark, sf_dir).snapshot())


def history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(history(spark, sf_dir).snapshot(as_of=2500))


def history_as_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(history(spark, sf_dir).snapshot(as_of=1500))


def history_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after versions that no read from 2500 on needs were dropped and the files merged."""
    log = history(spark, sf_dir)
    log.compact_history(2, 2500)
    log.compact_files()
    return _seen(log.snapshot())


def interop_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part through an exact-schema Arrow file and back."""
    spec = TableSpec("part", (ColumnSpec("at", SqlType("TIMESTAMP_NS"), False), ColumnSpec("p_partkey", SqlType("INT64")), ColumnSpec("p_name", SqlType("SYMBOL")), ColumnSpec("price", decimal(20, 8))), "at")
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(0).cast("long").alias("at"), "p_partkey", "p_name", (F.col("p_partkey") / 8).cast("decimal(20,8)").alias("price"))
    folder = tempfile.mkdtemp()
    interop.write_ipc(df, f"{folder}/part.arrow", spec)
    out = interop.read_ipc(spark, f"{folder}/part.arrow", spec)
    shutil.rmtree(folder)
    return out.select("p_partkey", "p_name", F.col("price").cast("double").alias("price"))


def view_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final windows of the streaming view over all events, by type and ten days: upserts first, then corrections that move every
    13th event by a day, then tombstones of every 17th.  Each phase is a run of the query from one checkpoint."""
    work, ten, day = _work(spark), 864_000_000_000, 86_400_000_000
    e = _events(spark, sf_dir).select(F.col("event_type").alias("grp"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    late = F.col("event_id") % 13 == 0
    phases = [e.withColumn("kind", F.lit("upsert")), e.where(late).withColumn("kind", F.lit("upsert")).withColumn("t", F.col("t") + day).withColumn("value", F.col("value") + 100), e.where("event_id % 17 = 0").withColumn("kind", F.lit("delete"))]
    for i, rows in enumerate(phases, 1):
        rows = rows.select("grp", F.lit(i).cast("long").alias("position"), F.col("event_id").cast("string").alias("identity"), "kind", "t", F.col("event_id").alias("ord"), "value", F.lit(1.0).alias("weight"))
        rows.write.mode("append").parquet(f"{work}/in")
        stream = stream_view(spark.readStream.schema(rows.schema).parquet(f"{work}/in"), ViewSpec(ten, ten))
        q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{work}/out")).outputMode("update").option("checkpointLocation", f"{work}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(f"{work}/out").groupBy("grp", "window_start").agg(F.max_by(F.struct("n", "least", "greatest", "open", "close"), "revision").alias("v"))
    return last.where("v.n > 0").select("grp", "window_start", "v.n", "v.least", "v.greatest", "v.open", "v.close")


def history_as_of_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of a time before the last commit, after the files of all commits were merged."""
    log = history(spark, sf_dir)
    log.compact_files()
    return _seen(log.snapshot(as_of=2500))


def history_changes_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's rows by operation, after the files were merged."""
    log = history(spark, sf_dir)
    log.compact_files()
    out = [df.select(F.lit(c.position).alias("position"), "_op", "value") for c, df in log.changes(0)]
    return out[0].union(out[1]).union(out[2]).groupBy("position", F.col("_op").alias("op")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


_LEFT = "SELECT c.event_id, c.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON c.user_id = v.user_id AND v.ts <= c.ts"
_US = "epoch_us(ts)"

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "asof_left": (asof_left, _LEFT),
    "asof_left_sliced": (lambda s, d: asof_left(s, d, slice_width=86_400_000_000), _LEFT),
    "asof_matches": (lambda s, d: asof_left(s, d, "inner"), f"SELECT * FROM ({_LEFT}) WHERE view_id IS NOT NULL"),
    "asof_two_steps": (asof_two_steps, "SELECT c.event_id, v.event_id AS view, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON c.user_id = v.user_id AND v.ts <= c.ts ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') AS p ON c.user_id = p.user_id AND p.ts <= c.ts"),
    "asof_then_aggregate": (asof_then_aggregate, f"SELECT user_id, count(*) AS clicks, count(view_id) AS after_view FROM ({_LEFT}) GROUP BY user_id"),
    "asof_misses": (asof_misses, f"SELECT event_id FROM ({_LEFT}) WHERE view_id IS NULL"),
    "ohlc_bars": (bars, "SELECT event_type, date_trunc('day', ts) AS b, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL"),
    "vwap": (weighted_price, "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap, count(*) AS n FROM lineitem GROUP BY ALL"),
    "recent_window": (recent_window, "SELECT event_type, count(*) AS n, max(value) AS top FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY event_type"),
    "latest_purchase": (latest_values, "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id"),
    "top_values": (top_values, "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 100"),
    "view_tumbling": (view_tumbling, f"SELECT event_type AS grp, {_US} - {_US} % 3600000000 AS window_start, count(*) AS n, min(value) AS least, max(value) AS greatest, arg_min(value, ts) AS open, arg_max(value, ts) AS close FROM events GROUP BY ALL"),
    "view_sliding": (view_sliding, f"SELECT event_type AS grp, {_US} - {_US} % 21600000000 - k * 21600000000 AS window_start, count(*) AS n, min(value) AS least, max(value) AS greatest, arg_min(value, ts) AS open, arg_max(value, ts) AS close FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY ALL"),
    "view_stream": (view_stream, "SELECT event_type AS grp, t - t % 864000000000 AS window_start, count(*) AS n, min(v) AS least, max(v) AS greatest, first(v ORDER BY t, event_id) AS open, last(v ORDER BY t, event_id) AS close FROM (SELECT event_type, event_id, epoch_us(ts) + CASE WHEN event_id % 13 = 0 THEN 86400000000 ELSE 0 END AS t, value + CASE WHEN event_id % 13 = 0 THEN 100 ELSE 0 END AS v FROM events WHERE event_id % 17 <> 0) GROUP BY ALL"),
    "history_as_of_compacted": (history_as_of_compacted, "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN value + 1000 ELSE value END AS value FROM events"),
    "history_changes_compacted": (history_changes_compacted, "SELECT 1 AS position, 'original' AS op, count(*) AS n, max(value) AS top FROM events UNION ALL SELECT 2, 'correction', count(*), max(value) + 1000 FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 3, 'tombstone', count(*), max(value) FROM events WHERE event_id % 11 = 0"),
    "history_current": (history_current, "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN value + 1000 ELSE value END AS value FROM events WHERE event_id % 11 <> 0"),
    "history_as_of": (history_as_of, "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN value + 1000 ELSE value END AS value FROM events"),
    "history_as_of_first": (history_as_of_first, "SELECT event_id, user_id, value FROM events"),
    "history_compacted": (history_compacted, "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN value + 1000 ELSE value END AS value FROM events WHERE event_id % 11 <> 0"),
    "interop_round_trip": (interop_round_trip, "SELECT p_partkey, p_name, CAST(p_partkey AS DOUBLE) / 8 AS price FROM part"),
}

QUERIES = {name: _statement(name) for name in STATEMENTS} | {name: f for name, (f, _) in FRAMES.items()}
SQL = {name: sql for name, (_, _, sql) in STATEMENTS.items()} | {name: sql for name, (_, sql) in FRAMES.items() if sql}
