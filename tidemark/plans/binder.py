"""Binds a parsed SELECT to sources and plans it as a DataFrame."""

from __future__ import annotations

import datetime
import hashlib
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.types import BINARY, BOOL, DATE, FLOAT64, INT64, STRING, TIMESTAMP, UUID, SqlType, TableSpec, common
from tidemark.operators import aggregates as A
from tidemark.operators.asof import asof_join
from tidemark.operators.rows import latest_by, ordered
from tidemark.plans.syntax import Expr, Select, SqlError

#: Hidden row-version columns of engine tables: commit position and ordinal in the commit.
VERSION = ("_pos", "_ord")


@dataclass
class Table:
    """A readable table; micros: event-time-like columns that the files hold as microsecond timestamps, by name."""

    spec: TableSpec
    df: DataFrame
    micros: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Typed:
    col: Column | None
    type: SqlType | None  # None: the untyped NULL
    nullable: bool = True
    aggregate: bool = False
    literal: object = None
    micros: Column | None = None
    bucket: tuple[Column, int] | None = None  # the time bucket of the row's file and its width, for the event time of a stored table
    risky: bool = False  # may raise


@dataclass
class Output:
    name: str
    type: SqlType
    nullable: bool
    aggregate: bool


@dataclass
class Bound:
    """A bound query: how to make its DataFrame, and what EXPLAIN and SUBSCRIBE tell of it."""

    select: Select
    tables: list[Table]
    outputs: list[Output]
    aggregate: bool
    make: object
    as_of: int | None

    def dataframe(self) -> DataFrame:
        return self.make(None)

    def fingerprint(self, sql: str) -> str:
        h = hashlib.sha256(sql.strip().encode())
        for t in self.tables:
            h.update(f"|{t.spec.name}:{t.spec.version}".encode())
        return h.hexdigest()

    def explain(self, analyze: bool = False) -> str:
        s = self.select
        stages = ["scan"] + ["latest"] * bool(s.latest) + ["asof_left" if j.left else "asof" for j in s.joins] + ["filter"] * (s.where is not None) + ["aggregate"] * self.aggregate + ["project"] + ["sort"] * bool(s.order) + ["limit"] * (s.limit is not None)
        lines = ["plan_version=1", f"mode={'explain_analyze' if analyze else 'explain'}", f"sources={len(self.tables)}"]
        lines += [f"source.{i}={t.spec.name},version:{t.spec.version}" for i, t in enumerate(self.tables)]
        lines += [f"system_time_ns={'current' if self.as_of is None else self.as_of}", f"latest_keys={len(s.latest[0]) if s.latest else 0}", f"asof_joins={len(s.joins)}", f"filter={int(s.where is not None)}", f"aggregate={int(self.aggregate)}", f"group_keys={len(s.group)}", f"outputs={len(self.outputs)}"]
        lines += [f"output.{i}={o.name},type:{o.type},nullable:{int(o.nullable)},aggregate:{int(o.aggregate)}" for i, o in enumerate(self.outputs)]
        lines += [f"order_keys={len(s.order)}", f"limit={'none' if s.limit is None else s.limit}"]
        lines += [f"operator.{i}={x}" for i, x in enumerate(stages)]
        if analyze:
            seen: dict[str, Observation] = {}
            whole = Observation()
            self.make(seen).observe(whole, F.count(F.lit(1)).alias("output_rows")).write.format("noop").mode("overwrite").save()
            counts = {k: o.get[k] for k, o in seen.items()} | whole.get
            names = ("source_rows", "rows_after_latest", "rows_after_asof", "rows_after_where", "groups", "output_rows")
            lines += [f"counter.{k}={counts.get(k, 0)}" for k in names]
        return "\n".join(lines) + "\n"


class Binder:
    def __init__(self, catalog, select: Select):
        self.catalog, self.s = catalog, select
        self.sources: list[tuple[str, Table, bool]] = []  # alias, table, null-extended
        self.visible = 0
        self.no_aggregates: str | None = None
        self.inside = False
        self.grouped: list[tuple[Expr, str, Typed]] = []
        self.aggregates: list[tuple[Expr, str, Column, SqlType]] = []
        self.after = False

    def fail(self, code: str, message: str, e=None):
        raise SqlError(code, message, getattr(e, "span", (0, 0)))

    # names

    def internal(self, i: int, name: str) -> str:
        return f"s{i}.{name}"

    def column(self, e: Expr) -> Typed:
        *qualifier, name = e.value
        found = [(i, c) for i, (alias, t, _) in enumerate(self.sources[: self.visible]) if not qualifier or alias == qualifier[0] for c in t.spec.columns if c.name == name]
        if not found:
            if qualifier and qualifier[0] not in [a for a, _, _ in self.sources[: self.visible]]:
                self.fail("unknown_table", f"no source {qualifier[0]}", e)
            self.fail("unknown_column", f"no column {'.'.join(e.value)}", e)
        if len(found) > 1:
            self.fail("ambiguous_column", f"{name} is in several sources", e)
        i, c = found[0]
        alias, t, extended = self.sources[i]
        q = lambda n: F.col(f"`{self.internal(i, n)}`")
        bucket = (q("_bucket"), t.spec.bucket_ns) if name == t.spec.event_time and "_bucket" in t.df.columns else None
        return Typed(q(name), c.type, c.nullable or extended, micros=q(t.micros[name]) if name in t.micros else None, bucket=bucket)

    # expressions

    def bind(self, e: Expr) -> Typed:
        if self.after:
            for g, name, t in self.grouped:
                if g.same(e):
                    return replace(t, col=F.col(f"`{name}`"), micros=None)
        out = getattr(self, "_" + e.kind)(e)
        return out

    def value(self, e: Expr) -> Typed:
        """Bound, and not the untyped NULL."""
        t = self.bind(e)
        if t.type is None:
            self.fail("type_mismatch", "NULL has no type here", e)
        return t

    def _null(self, e):
        return Typed(F.lit(None), None)

    def _bool(self, e):
        return Typed(F.lit(e.value), BOOL, False, literal=e.value)

    def _int(self, e):
        v = int(e.value)
        if v >= 2**63:
            self.fail("invalid_literal", "the integer is out of the range of INT64", e)
        return Typed(F.lit(v).cast("long"), INT64, False, literal=v)

    def _float(self, e):
        v = float(e.value)
        if v == float("inf"):
            self.fail("invalid_literal", "the number is out of the range of FLOAT64", e)
        return Typed(F.lit(v), FLOAT64, False, literal=v)

    def _str(self, e):
        return Typed(F.lit(e.value), STRING, False, literal=e.value)

    def _hex(self, e):
        return Typed(F.lit(bytearray(bytes.fromhex(e.value))), BINARY, False)

    def _uuid(self, e):
        return Typed(F.lit(bytearray(e.value)), UUID, False)

    def _timestamp(self, e):
        return Typed(F.lit(e.value).cast("long"), TIMESTAMP, False, literal=e.value)

    def _interval(self, e):
        return Typed(F.lit(e.value).cast("long"), INT64, False, literal=e.value)

    def _date(self, e):
        return Typed(F.date_from_unix_date(F.lit(e.value)), DATE, False)

    def _star(self, e):
        self.fail("syntax", "* stands only in the select list or count(*)", e)

    def _column(self, e):
        if self.after and not self.inside:
            self.fail("not_grouped", f"{'.'.join(e.value)} is neither grouped nor aggregated", e)
        return self.column(e)

    def _cast(self, e):
        a, b = self.bind(e.args[0]), e.value
        if a.type is None:
            return Typed(F.lit(None).cast(b.spark()), b)
        ok = a.type == b or a.type.numeric and b.numeric or a.type.text and b.text or {a.type.name, b.name} == {"DATE", "TIMESTAMP_NS"}
        if not ok:
            self.fail("type_mismatch", f"no cast from {a.type} to {b}", e)
        return Typed(X.cast(a.col, a.type, b), b, a.nullable, a.aggregate, risky=True)

    def _unary(self, e):
        a = self.value(e.args[0])
        if e.value == "NOT":
            self.boolean(a, e)
            return Typed(~a.col, BOOL, a.nullable, a.aggregate, risky=a.risky)
        if not a.type.numeric:
            self.fail("type_mismatch", f"{e.value} takes a number", e)
        if e.value == "+":
            return a
        if a.type.unsigned:
            self.fail("type_mismatch", "- takes no unsigned number", e)
        return Typed(X.negate(a.col, a.type), a.type, a.nullable, a.aggregate, literal=None if a.literal is None else -a.literal, risky=True)

    def boolean(self, t: Typed, e: Expr) -> None:
        if t.type != BOOL:
            self.fail("type_mismatch", f"expected BOOL, not {t.type}", e)

    def pair(self, a: Expr, b: Expr, e: Expr) -> tuple[Typed, Typed, SqlType]:
        """Two operands in their common type; an untyped NULL takes the other's."""
        x, y = self.bind(a), self.bind(b)
        if x.type is None and y.type is None:
            self.fail("type_mismatch", "two untyped NULLs", e)
        t = y.type if x.type is None else x.type if y.type is None else common(x.type, y.type)
        if t is None:
            self.fail("type_mismatch", f"{x.type} and {y.type} have no common type", e)
        widen = lambda v: v if v.type == t else replace(v, col=v.col.cast(t.spark()), type=t)
        return widen(x), widen(y), t

    def compare(self, op: str, x: Typed, y: Typed, t: SqlType) -> Column:
        if t == TIMESTAMP and (x.micros is not None) != (y.micros is not None) and isinstance((y if x.micros is not None else x).literal, int):
            # against the stored microseconds, so that the scan can skip row groups; nanoseconds below them decide on bounds
            col, ns = (x.micros, y.literal) if x.micros is not None else (y.micros, x.literal)
            if x.micros is None:
                op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            us, rest = divmod(ns, 1000)
            if abs(us) < 8_000_000_000_000_000 and (op not in ("=", "<>") or not rest):
                at = F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)) if abs(us) < 6e16 else None
                op = {"<": "<=", ">=": ">"}.get(op, op) if rest else op
                return {"=": col == at, "<>": col != at, "<": col < at, "<=": col <= at, ">": col > at, ">=": col >= at}[op]
        out = X.compare(op, x.col, y.col, t)
        if x.bucket is not None and isinstance(y.literal, int):
            # implied by the comparison, and prunes the folders of the log
            col, n = x.bucket[0], y.literal // x.bucket[1]
            implied = {"=": col == n, "<": col <= n, "<=": col <= n, ">": col >= n, ">=": col >= n}.get(op)
            out = out if implied is None else out & implied
        return out

    def _binary(self, e):
        op = e.value
        if op in ("AND", "OR"):
            a, b = self.bind(e.args[0]), self.bind(e.args[1])
            for t, arg in ((a, e.args[0]), (b, e.args[1])):
                if t.type is not None:
                    self.boolean(t, arg)
            x, y = (F.lit(None).cast("boolean") if t.type is None else t.col for t in (a, b))
            both = x & y if op == "AND" else x | y
            if b.risky:  # the right side isn't evaluated where the left decides
                both = F.when(~x if op == "AND" else x, F.lit(op == "OR")).otherwise(both)
            return Typed(both, BOOL, a.nullable or b.nullable, a.aggregate or b.aggregate, risky=a.risky or b.risky)
        x, y, t = self.pair(*e.args, e)
        null, agg = x.nullable or y.nullable, x.aggregate or y.aggregate
        if op in ("+", "-", "*", "/", "%"):
            if not t.numeric:
                self.fail("type_mismatch", f"{op} takes numbers", e)
            return Typed(X.arithmetic(op, x.col, y.col, t), t, null, agg, risky=True)
        return Typed(self.compare(op, x, y, t), BOOL, null, agg, risky=x.risky or y.risky)

    def _is_null(self, e):
        a = self.bind(e.args[0])
        return Typed(a.col.isNotNull() if e.negated else a.col.isNull(), BOOL, False, a.aggregate, risky=a.risky)

    def _between(self, e):
        v, low, high = e.args
        x, lo, t1 = self.pair(v, low, e)
        x2, hi, t2 = self.pair(v, high, e)
        c = self.compare(">=", x, lo, t1) & self.compare("<=", x2, hi, t2)
        return Typed(~c if e.negated else c, BOOL, x.nullable or lo.nullable or hi.nullable, x.aggregate or lo.aggregate or hi.aggregate, risky=x.risky or lo.risky or hi.risky)

    def _in(self, e):
        v, *values = e.args
        parts = [self.pair(v, x, e) for x in values]
        t = parts[0][2]
        if all(p[2] == t and not p[1].risky for p in parts) and not t.floating and t != TIMESTAMP:
            c = parts[0][0].col.isin(*[p[1].col for p in parts])
        else:
            c = self.compare("=", *parts[0])
            for p in parts[1:]:
                c = c | self.compare("=", *p)
        return Typed(~c if e.negated else c, BOOL, any(p[0].nullable or p[1].nullable for p in parts), any(p[0].aggregate or p[1].aggregate for p in parts), risky=any(p[0].risky or p[1].risky for p in parts))

    def _call(self, e):
        name, args = e.value, e.args
        if name in A.NAMES:
            return self.aggregate(e)
        if name == "time_bucket":
            if len(args) != 2 or args[0].kind != "interval" or args[0].value <= 0:
                self.fail("type_mismatch", "time_bucket takes a positive INTERVAL literal and a timestamp", e)
            t = self.value(args[1])
            if t.type != TIMESTAMP:
                self.fail("type_mismatch", "time_bucket takes a TIMESTAMP_NS", e)
            return Typed(X.time_bucket(args[0].value, t.col), TIMESTAMP, t.nullable, t.aggregate)
        if name == "coalesce":
            if not args:
                self.fail("type_mismatch", "coalesce takes arguments", e)
            parts, t = [self.bind(a) for a in args], None
            for p in parts:
                if p.type is not None:
                    t = p.type if t is None else common(t, p.type) or self.fail("type_mismatch", "coalesce takes one type", e)
            if t is None:
                self.fail("type_mismatch", "coalesce of untyped NULLs", e)
            return Typed(F.coalesce(*[p.col.cast(t.spark()) for p in parts]), t, all(p.nullable for p in parts), any(p.aggregate for p in parts), risky=any(p.risky for p in parts))
        if name in ("abs", "lower", "upper"):
            if len(args) != 1:
                self.fail("type_mismatch", f"{name} takes one argument", e)
            a = self.value(args[0])
            if name == "abs" and a.type.numeric:
                return Typed(X.absolute(a.col, a.type), a.type, a.nullable, a.aggregate, risky=True)
            if name != "abs" and a.type.text:
                return Typed((X.lower if name == "lower" else X.upper)(a.col), a.type, a.nullable, a.aggregate)
            self.fail("type_mismatch", f"{name} doesn't take {a.type}", e)
        self.fail("unknown_function", f"no function {name}", e)

    def aggregate(self, e: Expr) -> Typed:
        if self.no_aggregates:
            self.fail("invalid_aggregate", f"no aggregate may stand in {self.no_aggregates}", e)
        if self.inside:
            self.fail("invalid_aggregate", "aggregates don't nest", e)
        name = e.value
        if len(e.args) != 1 or e.args[0].kind == "star" and name != "count":
            self.fail("type_mismatch", f"{name} takes one argument", e)
        for known, alias, _, t in self.aggregates:
            if known.same(e):
                return Typed(F.col(f"`{alias}`"), t, name != "count", True)
        col, t = None, None
        if e.args[0].kind != "star":
            self.inside = True
            a = self.bind(e.args[0]) if name == "count" else self.value(e.args[0])
            self.inside = False
            col, t = a.col, a.type
            if name in ("sum", "avg", "var_pop", "var_samp") and not t.numeric:
                self.fail("type_mismatch", f"{name} takes a number", e)
        out, alias = A.result_type(name, t), f"a{len(self.aggregates)}"
        self.aggregates.append((e, alias, A.aggregate(name, col, t), out))
        return Typed(F.col(f"`{alias}`"), out, name != "count", True)

    # clauses

    def table(self, source, as_of: int | None = None) -> Table:
        t = self.catalog.read(source.table, as_of)
        if t is None:
            self.fail("unknown_table", f"no table {source.table}", source)
        if source.alias in [a for a, _, _ in self.sources]:
            self.fail("duplicate_name", f"two sources named {source.alias}", source)
        return t

    def named(self, i: int, t: Table) -> DataFrame:
        return t.df.select(*[F.col(f"`{c}`").alias(self.internal(i, c)) for c in t.df.columns])

    def hidden(self, i: int) -> list[str]:
        t = self.sources[i][1]
        return [self.internal(i, c) for c in VERSION if c in t.df.columns]

    def query(self) -> Bound:
        s = self.s
        as_of = None if s.as_of is None else s.as_of.value
        self.sources.append((s.source.alias, self.table(s.source, as_of), False))
        self.visible = 1
        steps = []  # each DataFrame -> DataFrame, with the counter that follows it
        self.no_aggregates = "LATEST BY"
        if s.latest:
            keys = [self.column(k) for k in s.latest[0]]
            at = self.value(s.latest[1])
            if at.type != TIMESTAMP:
                self.fail("type_mismatch", "LATEST BY is ON a TIMESTAMP_NS", s.latest[1])
            by = [F.col(f"`{self.internal(0, c)}`") for c in self.sources[0][1].spec.order_key] + [F.col(f"`{c}`") for c in self.hidden(0)]
            steps.append((lambda df: latest_by(df, [k.col for k in keys], at.col, by), "rows_after_latest"))
        self.no_aggregates = "ON"
        if len(s.joins) > 63:
            self.fail("resource_limit", "more than 63 ASOF joins")
        for j in s.joins:
            steps.append((self.join(j), "rows_after_asof"))
        self.no_aggregates = "WHERE"
        if s.where is not None:
            w = self.bind(s.where)
            self.boolean(w, s.where)
            steps.append((lambda df: df.where(w.col), "rows_after_where"))
        self.no_aggregates = "GROUP BY"
        groups = []
        for i, g in enumerate(s.group):
            t = self.value(g)
            groups.append((g, f"g{i}", t))
        self.no_aggregates = None
        aggregated = bool(s.group) or any(self.has_aggregate(e) for e, _ in s.items) or any(self.has_aggregate(o.expr) for o in s.order)
        if aggregated:
            self.after, self.grouped = True, groups
            if any(e.kind == "star" for e, _ in s.items):
                self.fail("not_grouped", "* in an aggregate query")
        outputs, cols = [], []
        for e, alias in s.items:
            if e.kind == "star":
                for o, c in self.star(e):
                    outputs.append(o)
                    cols.append(c)
                continue
            t = self.value(e)
            name = alias or (e.value[-1] if e.kind == "column" else e.value if e.kind == "call" else "expression")
            outputs.append(Output(name, t.type, t.nullable, t.aggregate))
            cols.append(t.col)
        names = [o.name for o in outputs]
        if len(set(names)) != len(names):
            self.fail("duplicate_name", "output names repeat; name them with AS")
        order = []
        aliases = {alias: k for k, (e, alias) in enumerate(s.items) if alias}
        for o in s.order:
            if o.expr.kind == "column" and len(o.expr.value) == 1 and o.expr.value[0] in aliases:
                k = aliases[o.expr.value[0]]
                order.append((cols[k], o.descending, o.nulls))
            else:
                order.append((self.value(o.expr).col, o.descending, o.nulls))
        ties = [F.col(f"`{n}`") for _, n, _ in groups] if aggregated else [F.col(f"`{self.internal(0, c)}`") for c in self.sources[0][1].spec.dedup_key] + [F.col(f"`{c}`") for i in range(len(self.sources)) for c in self.hidden(i)]
        aggs = self.aggregates
        first = self.sources[0][1]

        def make(seen: dict | None) -> DataFrame:
            def watch(df: DataFrame, name: str) -> DataFrame:
                if seen is None:
                    return df
                seen[name] = Observation()
                return df.observe(seen[name], F.count(F.lit(1)).alias(name))

            df = watch(self.named(0, first), "source_rows")
            for step, name in steps:
                df = watch(step(df), name)
            if aggregated:
                computed = [c.alias(n) for _, n, c, _ in aggs] or [F.count(F.lit(1)).alias("a")]
                df = watch(df.groupBy(*[t.col.alias(n) for _, n, t in groups]).agg(*computed), "groups")
            out = [c.cast(o.type.spark()).alias(f"o{k}") for k, (c, o) in enumerate(zip(cols, outputs, strict=True))]
            if order:
                keys = [(F.col(f"`k{k}`"), d, n) for k, (_, d, n) in enumerate(order)]
                df = df.select(*out, *[c.alias(f"k{k}") for k, (c, _, _) in enumerate(order)], *[c.alias(f"t{k}") for k, c in enumerate(ties)])
                df = ordered(df, keys, [f"t{k}" for k in range(len(ties))])
            else:
                df = df.select(*out)
            if s.limit is not None:
                df = df.limit(s.limit)
            return df.select(*[F.col(f"o{k}").alias(o.name) for k, o in enumerate(outputs)])

        return Bound(s, [t for _, t, _ in self.sources], outputs, aggregated, make, as_of)

    def has_aggregate(self, e: Expr) -> bool:
        return e.kind == "call" and e.value in A.NAMES or any(self.has_aggregate(a) for a in e.args)

    def star(self, e: Expr):
        if e.value is not None and e.value not in [a for a, _, _ in self.sources]:
            self.fail("unknown_table", f"no source {e.value}", e)
        names = [c.name for _, t, _ in self.sources for c in t.spec.columns]
        for i, (alias, t, extended) in enumerate(self.sources):
            if e.value in (None, alias):
                for c in t.spec.columns:
                    name = f"{alias}.{c.name}" if e.value is None and names.count(c.name) > 1 else c.name
                    yield Output(name, c.type, c.nullable or extended, False), F.col(f"`{self.internal(i, c.name)}`")

    def join(self, j):
        i = len(self.sources)
        self.sources.append((j.source.alias, self.table(j.source), j.left))
        self.visible = i + 1
        right = self.sources[i][1]
        keys, time = [], None

        def conjuncts(e: Expr):
            if e.kind == "binary" and e.value == "AND":
                yield from conjuncts(e.args[0])
                yield from conjuncts(e.args[1])
            else:
                yield e

        def uses(e: Expr) -> set[bool]:
            """Whether columns of the joined source (True) and of earlier ones (False) occur."""
            out = {x for a in e.args for x in uses(a)}
            if e.kind == "column":
                q = e.value[0] if len(e.value) == 2 else None
                self.column(e)
                own = q == j.source.alias if q else e.value[-1] in [c.name for c in right.spec.columns]
                out.add(own)
            return out

        for c in conjuncts(j.on):
            if c.kind != "binary" or c.value not in ("=", "<=", ">="):
                self.fail("invalid_asof", "ON takes equalities and one time condition", c)
            a, b = c.args
            ua, ub = uses(a), uses(b)
            if ua == {True} and ub == {False}:
                a, b, op = b, a, {"<=": ">=", ">=": "<=", "=": "="}[c.value]
            elif ua == {False} and ub == {True}:
                op = c.value
            else:
                self.fail("invalid_asof", "each condition compares the joined source with earlier ones", c)
            x, y, t = self.pair(a, b, c)  # x: earlier, y: joined
            if op == "=":
                keys.append((x.col, y.col))
            elif op == ">=" and t == TIMESTAMP and time is None:
                time = (x.col, y.col)
            else:
                self.fail("invalid_asof", "the time condition is one right.ts <= left.ts", c)
        if not keys or time is None:
            self.fail("invalid_asof", "ON takes at least one equality and a time condition", j.on)
        ties = [F.col(f"`{self.internal(i, c)}`") for c in right.spec.order_key] + [F.col(f"`{c}`") for c in self.hidden(i)]
        frame = self.named(i, right)
        return lambda df: asof_join(df, frame, keys, *time, ties, "left" if j.left else "inner")


def bind(catalog, select: Select) -> Bound:
    return Binder(catalog, select).query()


def constant(e: Expr, t: SqlType, nullable: bool):
    """Value of a constant expression for INSERT, as Python holds it for Spark; lossless assignments only."""
    b = Binder(None, None)
    v = b.bind(e)
    if v.type is None:
        if not nullable:
            b.fail("null_violation", "NULL in a NOT NULL column", e)
        return F.lit(None).cast(t.spark())
    if v.type != t and not (common(v.type, t) == t or v.type.text and t.text):
        small = v.type == INT64 and isinstance(v.literal, int) and t.integer and ((0 if t.unsigned else -(2 ** (int(t.name[3:]) - 1))) <= v.literal <= (t.range()[1] if t.unsigned else 2 ** (int(t.name[3:]) - 1) - 1))
        if not small:
            b.fail("type_mismatch", f"{v.type} can't be assigned to {t} without loss", e)
    return (F.lit(Decimal(v.literal)) if t.name == "UINT64" and isinstance(v.literal, int) else v.col).cast(t.spark())
