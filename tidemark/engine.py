"""The engine: a catalog of tables, and statements over them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exprs as X
from tidemark.functions.types import ColumnSpec, SqlType, TableSpec, of_spark
from tidemark.plans import syntax as S
from tidemark.plans.binder import Bound, Table, bind, constant
from tidemark.session import configure
from tidemark.sources.store import VersionLog
from tidemark.streaming.subscription import SubscriptionLog


class Engine:
    """execute() runs a statement of the dialect; table data comes from register() (any DataFrame), CREATE TABLE and INSERT, or a VersionLog."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = configure(spark), root
        self.external: dict[str, tuple[TableSpec, Callable[[], DataFrame], dict[str, str]]] = {}
        self.logs: dict[str, VersionLog] = {}
        self.generation = 0
        self.token_key = secrets.token_bytes(32)
        self._batch = 0

    # catalog

    def read(self, name: str, as_of: int | None = None) -> Table | None:
        if name in self.logs:
            log = self.logs[name]
            return Table(log.spec, log.snapshot(as_of, hidden=True))
        if name in self.external:
            if as_of is not None:
                raise S.SqlError("unsupported", f"{name} keeps no system time")
            spec, make, micros = self.external[name]
            return Table(spec, make(), micros)
        return None

    def register(self, name: str, df: DataFrame, event_time: str, order_key: tuple = (), dedup_key: tuple = (), symbols: tuple = ()) -> TableSpec:
        """A DataFrame as a table.  Microsecond timestamps read as TIMESTAMP_NS; predicates on them still reach the scan."""
        columns, micros, out = [], {}, []
        df = self._own(df)
        for f in df.schema.fields:
            t = SqlType("SYMBOL") if f.name in symbols else of_spark(f.dataType)
            columns.append(ColumnSpec(f.name, t, f.nullable and f.name != event_time))
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                micros[f.name] = f"{f.name}__us"
                out += [X.nanos(F.col(f"`{f.name}`")).alias(f.name), F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f"{f.name}__us")]
            else:
                out.append(F.col(f"`{f.name}`"))
        spec = TableSpec(name, tuple(columns), event_time, order_key, dedup_key=dedup_key)
        self.external[name] = (spec, lambda: df.select(*out), micros)
        self.generation += 1
        return spec

    def _own(self, df: DataFrame) -> DataFrame:
        """The same plan under the engine's session settings."""
        if df.sparkSession is self.spark:
            return df
        return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan()), self.spark)

    def create(self, spec: TableSpec) -> VersionLog:
        if self.root is None:
            raise S.SqlError("unsupported", "the engine has no folder for tables")
        if spec.name in self.logs or spec.name in self.external:
            raise S.SqlError("duplicate_name", f"{spec.name} exists")
        self.logs[spec.name] = VersionLog(self.spark, self.root, spec)
        self.generation += 1
        return self.logs[spec.name]

    # statements

    def bind(self, sql: str) -> Bound:
        s = S.parse(sql)
        if not isinstance(s, S.Select):
            raise S.SqlError("syntax", "expected a SELECT")
        return bind(self, s)

    def sql(self, sql: str) -> DataFrame:
        """DataFrame of a SELECT."""
        return self.bind(sql).dataframe()

    def execute(self, sql: str):
        """SELECT: a DataFrame.  EXPLAIN [ANALYZE]: text.  SUBSCRIBE: a subscription.  CREATE TABLE: the table.  INSERT: the commit."""
        s = S.parse(sql)
        if isinstance(s, S.CreateTable):
            return self._create(s)
        if isinstance(s, S.Insert):
            return self._insert(s)
        b = bind(self, s)
        if s.mode.startswith("explain"):
            return b.explain(s.mode == "explain_analyze")
        if s.mode == "subscribe":
            return self.subscribe(sql)
        return b.dataframe()

    def _create(self, s: S.CreateTable) -> VersionLog:
        p = s.partition
        if not (p.kind == "call" and p.value == "time_bucket" and len(p.args) == 2 and p.args[0].kind == "interval" and p.args[0].value > 0 and p.args[1].kind == "column" and p.args[1].value == (s.event_time,)):
            raise S.SqlError("invalid_table", "PARTITION BY takes time_bucket(INTERVAL, event time)", p.span)
        try:
            spec = TableSpec(s.table, tuple(ColumnSpec(*c) for c in s.columns), s.event_time, tuple(s.order_key), tuple(s.shard_key), tuple(s.dedup_key), p.args[0].value, s.retention_ns, s.history_ns, s.lateness_ns)
        except ValueError as e:
            raise S.SqlError("invalid_table", str(e)) from None
        return self.create(spec)

    def _insert(self, s: S.Insert):
        log = self.logs.get(s.table)
        if log is None:
            raise S.SqlError("unknown_table", f"no table {s.table}")
        spec = log.spec
        names = s.columns or [c.name for c in spec.columns]
        known = [c.name for c in spec.columns]
        for n in names:
            if n not in known:
                raise S.SqlError("unknown_column", f"no column {n}")
        if len(set(names)) != len(names):
            raise S.SqlError("duplicate_name", "a column is named twice")
        rows = []
        for row in s.rows:
            if len(row) != len(names):
                raise S.SqlError("type_mismatch", f"{len(row)} values for {len(names)} columns")
            given = dict(zip(names, row, strict=True))
            rows.append(F.struct(*[constant(given.get(c.name, S.Expr("null")), c.type, c.nullable).alias(c.name) for c in spec.columns]))
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        self._batch += 1
        return log.append(df, "sql", f"{id(self)}-{self._batch}")

    def subscribe(self, sql: str, key: bytes | None = None, capacity: int = 1024) -> SubscriptionLog:
        """key signs resume tokens; without one they hold for this engine only."""
        return SubscriptionLog(self, sql, key or self.token_key, capacity)
