"""Subscriptions: a result at a boundary, then every later commit once."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import syntax as S


class SubscriptionError(Exception):
    """code: ineligible bad_token wrong_plan wrong_schema ahead expired overflow closed schema_changed bad_ack."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Change:
    """kind: snapshot, upsert, delete or ready.  `data` is a plan over immutable files, run when it is read: a buffered
    change holds no rows.  A delete's rows are the identities that are no longer in the result."""

    sequence: int
    position: int
    kind: str
    key: str
    data: DataFrame | None

    @property
    def rows(self) -> list[tuple]:
        """All rows on the driver, for small changes."""
        return list(self.pages())

    def pages(self) -> Iterator[tuple]:
        """The rows, a partition at a time on the driver."""
        return (tuple(r) for r in self.data.toLocalIterator()) if self.data is not None else iter(())


def token(key: bytes, plan: str, version: int, position: int, sequence: int) -> str:
    """Signed place in a stream."""
    body = json.dumps([plan, version, position, sequence], separators=(",", ":"))
    return f"{body}.{hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}"


def read_token(key: bytes, text: str) -> tuple[str, int, int, int]:
    body, _, mac = text.rpartition(".")
    if not hmac.compare_digest(mac, hmac.new(key, body.encode(), hashlib.sha256).hexdigest()):
        raise SubscriptionError("bad_token", "the token's signature doesn't match")
    return tuple(json.loads(body))


class SubscriptionLog:
    """One subscription.

    Opening it fixes boundary C and offers the query over the snapshot at C; commits past C are evaluated one by one.  Each gives an
    upsert keyed by plan, table and position, and, if it holds corrections or tombstones, a delete of the identities that it
    takes out of the result.  pump() takes in new commits; when the buffer is full the subscriber is cut
    off and the commits stand.  poll() hands out at least once, ack() up to what was polled.  Only row-preserving plans over one
    current source qualify: no system time, LATEST BY, ASOF, aggregate, ORDER BY or LIMIT."""

    def __init__(self, engine, sql: str, key: bytes, capacity: int, resume: str | None = None):
        s = S.parse(sql)
        if not isinstance(s, S.Select) or s.mode != "subscribe":
            raise SubscriptionError("ineligible", "expected SUBSCRIBE SELECT")
        self.engine, self.sql, self.key, self.capacity = engine, sql, key, capacity
        bound = engine.bind(sql)
        if s.as_of or s.latest or s.joins or bound.aggregate or s.order or s.limit is not None:
            raise SubscriptionError("ineligible", "only filters and projections of one current table can be subscribed to")
        self.table = engine.logs.get(s.source.table)
        if self.table is None:
            raise SubscriptionError("ineligible", "the table keeps no commits")
        self.plan, self.version = bound.fingerprint(sql), self.table.spec.version
        self.buffer: deque[Change] = deque()
        self.polled = self.acked = self.sequence = 0
        self.closed: SubscriptionError | None = None
        self.position = 0
        if resume is None:
            self.position = self.table.boundary(None)
            self._offer("snapshot", self.position, self.snapshot())
            self._offer("ready", self.position, None)
        else:
            plan, version, position, sequence = read_token(key, resume)
            if plan != self.plan:
                raise SubscriptionError("wrong_plan", "the token is of another query")
            if version != self.version:
                raise SubscriptionError("wrong_schema", "the table's schema has changed")
            if position > self.table.boundary(None):
                raise SubscriptionError("ahead", "the token is ahead of the table")
            if position < self.table.folded:
                raise SubscriptionError("expired", "commits past the token are gone")
            self.position, self.sequence, self.polled, self.acked = position, sequence, sequence, sequence
        self.table.readers.add(self)

    def _run(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The query over given rows of its table; its predicate alone, with the given columns, if they are named."""

        class One:
            def read(inner, name, as_of=None):
                from tidemark.plans.binder import Table

                return Table(self.table.spec, df)

        from tidemark.plans.binder import bind

        s = S.parse(self.sql)
        if columns is not None:
            s.items = [(S.Expr("column", (c,)), None) for c in columns]
        return bind(One(), s).dataframe()

    def snapshot(self) -> DataFrame:
        """The result at the boundary, as a DataFrame."""
        return self._run(self.table.snapshot(position=self.position))

    def _offer(self, kind: str, position: int, data: DataFrame | None) -> None:
        if len(self.buffer) >= self.capacity:
            self.closed = SubscriptionError("overflow", "the subscriber fell behind")
            self.buffer.clear()
            return
        self.sequence += 1
        self.buffer.append(Change(self.sequence, position, kind, f"{self.plan[:16]}:{self.table.spec.name}:{position}:{self.sequence}", data))

    def pump(self) -> int:
        """Takes in commits past the position; how many."""
        n = 0
        if self.closed:
            return 0
        if self.table.spec.version != self.version:
            self.closed = SubscriptionError("schema_changed", "the table's schema has changed")
            return 0
        if self.position < self.table.folded:
            self.closed = SubscriptionError("expired", "commits past the position are gone")
            return 0
        for c, rows in self.table.changes(self.position):
            self._offer("upsert", c.position, self._run(rows.where(F.col("_op") != "tombstone")))
            if c.corrected and not self.closed:
                self._offer("delete", c.position, self._gone(rows))
            if self.closed:
                break
            self.position, n = c.position, n + 1
        return n

    def _gone(self, rows: DataFrame) -> DataFrame:
        """Identities of the commit's tombstones, and of those of its versions that fail the query's predicate."""
        key = self.table.identity()
        inside = self._run(rows, key).distinct()
        versions = rows.where(F.col("_op") != "original")
        stays = versions.where(F.col("_op") != "tombstone").join(inside, key, "left_semi")
        return versions.select(*key).join(stays.select(*key), key, "left_anti")

    def poll(self, most: int = 100) -> list[Change]:
        if self.closed:
            raise self.closed
        out = [c for c in self.buffer][:most]
        if out:
            self.polled = max(self.polled, out[-1].sequence)
        return out

    def ack(self, sequence: int) -> str:
        """Forgets what was handled; a token to resume from there."""
        if self.closed:
            raise self.closed
        if sequence > self.polled or sequence < self.acked:
            raise SubscriptionError("bad_ack", "an ack lies between the last one and the last poll")
        position = self.position if not self.buffer else None
        while self.buffer and self.buffer[0].sequence <= sequence:
            position = self.buffer.popleft().position
        self.acked = sequence
        return token(self.key, self.plan, self.version, position if position is not None else self.buffer[0].position - 1, sequence)

    def cancel(self) -> None:
        self.closed = SubscriptionError("closed", "cancelled")
        self.buffer.clear()

    def safe_position(self) -> int:
        """The table's log must keep commits past this."""
        return min([self.position, *(c.position - 1 for c in self.buffer)])


class CommitOrder:
    """One recorded admission order over the commits of several tables; with a VersionLog's file helpers in `store`, it is kept in numbered files."""

    def __init__(self, tables: dict, store=None):
        self.tables, self.store, self.order, self.at = tables, store, [], dict.fromkeys(tables, 0)
        for n in store._numbers("order") if store else ():
            self._take([tuple(x) for x in store._entry("order", n)["admitted"]])

    def _take(self, admitted: list[tuple[int, str, int]]) -> None:
        for _, name, position in admitted:
            self.at[name] = position
        self.order += admitted

    def admit(self) -> list[tuple[int, str, int]]:
        """New commits as (global sequence, table, position), by system time and name; the order is kept for ever."""
        new = sorted((c.time_ns, name, c.position) for name, t in self.tables.items() for c in t.commits if c.position > self.at[name])
        at, out = dict(self.at), []
        for _, name, position in new:
            if position != at[name] + 1:
                raise SubscriptionError("expired", f"{name} misses a commit")
            at[name] = position
            out.append((len(self.order) + len(out) + 1, name, position))
        if out and self.store:
            self.store._publish("order", out[0][0], {"admitted": out})
        self._take(out)
        return out


def reclaimable(subscriptions: list[SubscriptionLog]) -> int | None:
    """Commits up to this position are needed by no subscriber; None if there are no subscribers."""
    return min((s.safe_position() for s in subscriptions if not s.closed), default=None)
