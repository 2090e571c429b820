"""The dialect, value semantics, LATEST BY, ASOF, the version log, views and subscriptions."""

import datetime
import random
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import exprs as X
from tidemark.functions.types import SqlType, TableSpec, ColumnSpec, decimal
from tidemark.plans.syntax import SqlError, parse
from tidemark.session import configure
from tidemark.sources import interop
from tidemark.sources.store import StoreError
from tidemark.streaming import view
from tidemark.streaming.subscription import CommitOrder, SubscriptionError, SubscriptionLog
from tidemark.streaming.view import CORRECTED, FINALIZED, PROVISIONAL, GroupView, View, ViewError, ViewSpec, Window

CREATE = """CREATE TABLE {name} (ts TIMESTAMP_NS NOT NULL, symbol SYMBOL NOT NULL, price FLOAT64, qty INT64) EVENT TIME ts ORDER KEY (symbol, ts)
  PARTITION BY time_bucket(INTERVAL '1 day', ts) SHARD KEY (symbol) DEDUP KEY (symbol, ts) RETENTION INTERVAL '30 days'
  SYSTEM HISTORY RETENTION INTERVAL '7 days' ALLOWED LATENESS INTERVAL '1 hour'"""


def ts(n: int) -> str:
    return f"TIMESTAMP '1970-01-01 00:00:00.{n:09d}Z'"


def made(seed: int, n: int, symbols: str) -> list[tuple]:
    """(ts, symbol, price) with times of their own and prices in quarters, some of them NULL."""
    rng = random.Random(seed)
    times = rng.sample(range(100, 5000), n)
    return [(t, rng.choice(symbols), None if rng.random() < 0.15 else rng.randint(-40, 40) / 4) for t in times]


TRADES, QUOTES = made(1, 40, "KLMN"), made(2, 30, "KLM")


def insert(e, table, rows, column):
    e.execute(f"INSERT INTO {table} (ts, symbol, {column}) VALUES " + ", ".join(f"({ts(t)}, '{s}', {'NULL' if v is None else v})" for t, s, v in rows))


@pytest.fixture
def eng(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.execute(CREATE.format(name="trades"))
    insert(e, "trades", TRADES, "price")
    e.execute(CREATE.format(name="quotes").replace("price", "bid"))
    insert(e, "quotes", QUOTES, "bid")
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def prior(t, symbol):
    """The quote at or before a time."""
    return max((q for q in QUOTES if q[1] == symbol and q[0] <= t), default=(None, None, None))


def test_asof_in_the_dialect(eng):
    """Every trade with its last quote, inner and left, against a search for each."""
    sql = "SELECT t.ts AS ts, q.ts AS at, q.bid AS bid FROM trades AS t ASOF {} quotes AS q ON t.symbol = q.symbol AND q.ts <= t.ts ORDER BY t.ts"
    want = [(t, prior(t, s)[0], prior(t, s)[2]) for t, s, _ in sorted(TRADES)]
    assert rows(eng.sql(sql.format("LEFT JOIN"))) == want
    assert rows(eng.sql(sql.format("JOIN"))) == [x for x in want if x[1] is not None]


def test_latest_asof_where_order_limit(eng):
    last = {s: max(x for x in TRADES if x[1] == s) for s in "KLMN"}
    want = [(s, t, prior(t, s)[2]) for s, (t, _, p) in last.items() if p is not None and p <= 40]
    want.sort(key=lambda x: (x[2] is None, -(x[2] or 0)))
    out = rows(eng.sql("SELECT t.symbol AS symbol, t.ts AS ts, q.bid AS bid FROM trades AS t LATEST BY (symbol) ON ts ASOF LEFT JOIN quotes AS q ON t.symbol = q.symbol AND q.ts <= t.ts WHERE t.price <= 40.0 ORDER BY q.bid DESC NULLS LAST LIMIT 3"))
    assert len(out) == min(3, len(want)) and {x[2] for x in out} == {x[2] for x in want[:3]} and set(out) <= set(want)


def test_grouped_aggregates(eng):
    eng.execute(f"INSERT INTO trades (ts, symbol, price) VALUES ({ts(7)}, 'Z', NULL)")
    out = {r[0]: r[1:] for r in rows(eng.sql("SELECT symbol, count(*) AS n, count(price) AS c, sum(price) AS s, var_pop(price) AS vp, var_samp(price) AS vs FROM trades GROUP BY symbol"))}
    assert out.pop("Z") == (1, 0, None, None, None)
    for s in "KLMN":
        v = [p for _, x, p in TRADES if x == s and p is not None]
        mean = sum(v) / len(v)
        m2 = sum((x - mean) ** 2 for x in v)
        assert out[s] == (sum(x == s for _, x, _ in TRADES), len(v), sum(v), pytest.approx(m2 / len(v)), pytest.approx(m2 / (len(v) - 1)))


def test_exact_sum(spark, tmp_path):
    """Sums beyond bigint on the way are exact; only a final value beyond it is an error."""
    e = Engine(spark, f"file://{tmp_path}")
    e.execute(CREATE.format(name="t"))
    rng = random.Random(5)
    big = [rng.randrange(2**61, 2**63) for _ in range(6)]
    values = [*big, *[-x + rng.randint(-1000, 1000) for x in big], -(2**62), 12345]
    e.execute("INSERT INTO t (ts, symbol, qty) VALUES " + ", ".join(f"({ts(i)}, 'x', {v})" for i, v in enumerate(values, 1)))
    assert rows(e.sql("SELECT sum(qty) AS s FROM t")) == [(sum(values),)]
    with pytest.raises(Exception, match="overflow|range|OVERFLOW|RANGE"):
        e.sql("SELECT sum(qty) AS s FROM t WHERE qty > 0").collect()


@pytest.mark.parametrize("sql,code", [
    ("SELECT a FROM trades", "unknown_column"), ("SELECT ts FROM nope", "unknown_table"), ("SELECT price + qty FROM trades", "type_mismatch"), ("SELECT symbol, count(*) FROM trades", "not_grouped"),
    ("SELECT ts FROM trades WHERE sum(qty) > 1", "invalid_aggregate"), ("SELECT sum(sum(qty)) FROM trades", "invalid_aggregate"), ("SELECT ts, ts FROM trades", "duplicate_name"), ("SELECT floor(price) FROM trades", "unknown_function"),
    ("SELECT DISTINCT ts FROM trades", "syntax"), ("SELECT t.ts FROM trades AS t ASOF JOIN quotes AS q ON q.ts <= t.ts", "invalid_asof"), ("SELECT ts FROM trades AS t ASOF JOIN quotes AS q ON t.symbol = q.symbol AND q.ts <= t.ts", "ambiguous_column"),
    ("SELECT -9223372036854775808 AS x FROM trades", "invalid_literal"), ("SELECT NULL AS x FROM trades", "type_mismatch"), ("SELECT X'abc' AS x FROM trades", "invalid_token"),
])
def test_rejections(eng, sql, code):
    with pytest.raises(SqlError) as e:
        eng.sql(sql)
    assert e.value.code == code


def test_literals():
    s = parse("SELECT TIMESTAMP '1677-09-21 00:12:43.145224192Z' AS e FROM t")
    assert s.items[0][0].value == -(2**63)
    with pytest.raises(SqlError):
        parse("SELECT TIMESTAMP '2024-02-30 00:00:00Z' AS e FROM t")


def test_value_semantics(spark):
    s = configure(spark)
    nan, f64 = F.lit(float("nan")), SqlType("FLOAT64")
    r = s.range(1).select(
        X.compare("=", nan, nan, f64).alias("eq"), X.compare("<>", nan, F.lit(1.0), f64).alias("ne"), X.compare(">", nan, F.lit(1.0), f64).alias("gt"), X.arithmetic("/", F.lit(-1.0), F.lit(0.0), f64).alias("inf"), X.lower(F.lit("ÀB")).alias("low"),
        X.arithmetic("/", F.lit(-7).cast("long"), F.lit(2).cast("long"), SqlType("INT64")).alias("q"), X.cast(F.lit("-1.999").cast("decimal(6,3)"), decimal(6, 3), decimal(5, 2)).alias("cut"), X.time_bucket(10, F.lit(-1).cast("long")).alias("b"),
        X.arithmetic("*", F.lit("1.11").cast("decimal(6,2)"), F.lit("-1.19").cast("decimal(6,2)"), decimal(6, 2)).alias("m"), X.arithmetic("/", F.lit("2.00").cast("decimal(6,2)"), F.lit("3.00").cast("decimal(6,2)"), decimal(6, 2)).alias("d"),
        X.arithmetic("*", F.lit("99999999999999999999.123456789").cast("decimal(38,9)"), F.lit("1.5").cast("decimal(38,9)"), decimal(38, 9)).alias("big"), X.cast(F.lit(0.1), f64, decimal(30, 25)).alias("exact"),
    ).first()
    assert (r.eq, r.ne, r.gt, r.inf, r.low, r.q, r.b) == (False, True, False, float("-inf"), "Àb", -3, -10)
    assert (r.cut, r.m, r.d, r.big, r.exact) == (Decimal("-1.99"), Decimal("-1.32"), Decimal("0.66"), Decimal("149999999999999999998.685185183"), Decimal("0.1000000000000000055511151"))


def history(spark, tmp_path, seed=7, commits=5):
    """A log of random originals, corrections and tombstones, and a model of it: what is visible after each position."""
    e = Engine(spark, f"file://{tmp_path}")
    spec = TableSpec("m", (ColumnSpec("ts", SqlType("TIMESTAMP_NS"), False), ColumnSpec("value", SqlType("INT64"), False), ColumnSpec("key", SqlType("STRING"), False)), "ts", ("key",), ("key",), ("key",))
    log, rng, state, model, sent = e.create(spec), random.Random(seed), {}, [{}], []
    known = set()
    for p in range(1, commits + 1):
        new = [f"k{p}-{i}" for i in range(4)]
        old = rng.sample(sorted(known), min(len(known), 5)) if p % 3 else []
        given = [(rng.randrange(10**15), rng.randrange(1000), k, "original") for k in new] + [(rng.randrange(10**15), rng.randrange(1000), k, rng.choice(["correction", "tombstone"])) for k in old]
        df = e.spark.createDataFrame(given, "ts long, value long, key string, _op string")
        if old:
            log.apply(df, p * 1000)
        else:
            sent.append((df.drop("_op"), f"batch{p}", log.append(df.drop("_op"), "client", f"batch{p}", p * 1000)))
        for _, v, k, op in given:
            state.pop(k, None)
            if op != "tombstone":
                state[k] = v
        known |= set(new)
        model.append(dict(state))
    return e, log, model, sent


def seen(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize("compact", [lambda log: None, lambda log: (log.compact_files(), log.compact_files(), log.vacuum())])
def test_system_time(spark, tmp_path, compact):
    """As-of reads at every position, changes of every commit and retries, the same before and after files are merged and after a restart."""
    e, log, model, sent = history(spark, tmp_path)
    before = [(c.position, sorted(rows(df.select("key", "value", "_op")))) for c, df in log.changes(0)]
    compact(log)
    for again in (log, type(log)(log.spark, f"file://{tmp_path}", log.spec)):
        for p, want in enumerate(model):
            assert seen(again.snapshot(as_of=p * 1000 + 500)) == want == seen(again.snapshot(position=p))
        assert [(c.position, sorted(rows(df.select("key", "value", "_op")))) for c, df in again.changes(0)] == before
        for df, batch, commit in sent:
            assert again.append(df, "client", batch) == commit
            with pytest.raises(StoreError, match="conflict"):
                again.append(df.withColumn("value", F.col("value") + 1), "client", batch)
    q = "SELECT value FROM m FOR SYSTEM_TIME AS OF TIMESTAMP '1970-01-01 00:00:00.000002500Z'"
    assert sorted(rows(e.sql(q))) == sorted((v,) for v in model[2].values())
    df = sent[0][0]
    with pytest.raises(StoreError, match="duplicate"):
        log.append(df, "client", "other")
    with pytest.raises(StoreError, match="conflict"):
        log.apply(df.limit(1).withColumn("_op", F.lit("original")))


def test_history_compaction(spark, tmp_path):
    """Reads from the boundary on stay; earlier ones and changes across it are refused; a subscriber holds it back."""
    _, log, model, _ = history(spark, tmp_path)
    assert log.compact_history(0, 500) == 0
    dropped = log.compact_history(4, 4500)
    assert dropped > 0 and log.folded == 4
    for p, want in list(enumerate(model))[4:]:
        assert seen(log.snapshot(as_of=p * 1000 + 500)) == want
    for refused in (lambda: log.snapshot(as_of=3500), lambda: log.snapshot(position=3), lambda: log.changes(3)):
        with pytest.raises(StoreError, match="not_found"):
            refused()
    with pytest.raises(StoreError, match="invalid"):
        log.compact_history(3, 4500)
    assert [c.position for c, _ in log.changes(4)] == [5]
    log.compact_files()
    assert seen(log.snapshot()) == model[-1] and log.folded == 4

    class Reader:
        closed = None

        def safe_position(self):
            return 4

    reader = Reader()
    log.readers.add(reader)
    log.compact_history(5, 5500)
    assert log.folded == 4
    del reader
    log.compact_history(5, 5500)
    assert log.folded == 5 and seen(log.snapshot()) == model[-1]


def test_two_writers(spark, tmp_path):
    """A position is published once; the other writer is told, and goes on after a refresh.  Schema versions are kept."""
    _, log, model, _ = history(spark, tmp_path, commits=2)
    other = type(log)(log.spark, f"file://{tmp_path}", log.spec)
    row = lambda k: log.spark.createDataFrame([(1, 1, k)], "ts long, value long, key string")
    log.append(row("a"), "one", "1")
    with pytest.raises(StoreError, match="conflict"):
        other.append(row("b"), "two", "1")
    other.refresh()
    other.append(row("b"), "two", "1")
    log.refresh()
    assert seen(log.snapshot()) == model[-1] | {"a": 1, "b": 1}
    log.evolve(ColumnSpec("note", SqlType("STRING")))
    again = type(log)(log.spark, f"file://{tmp_path}", other.spec)
    assert again.spec == log.spec and again.spec.version == 2 and {r.note for r in again.snapshot().collect()} == {None}


def test_bucket_pruning(eng):
    """Time predicates choose the log's folders."""
    plan = eng.sql(f"SELECT price FROM trades WHERE ts >= {ts(50)}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and ">= 0)" in plan


def test_explain(eng):
    text = eng.execute("EXPLAIN SELECT price AS v FROM trades WHERE price > 0.0 ORDER BY v LIMIT 2")
    assert "output.0=v,type:FLOAT64,nullable:1,aggregate:0" in text and "operator.3=sort" in text
    text = eng.execute("EXPLAIN ANALYZE SELECT symbol, count(*) AS n FROM trades WHERE price > 0.0 GROUP BY symbol")
    up = [s for _, s, p in TRADES if p is not None and p > 0]
    assert f"counter.source_rows={len(TRADES)}\n" in text and f"counter.rows_after_where={len(up)}\n" in text and f"counter.groups={len(set(up))}\ncounter.output_rows={len(set(up))}\n" in text


def test_pushdown(spark):
    e = Engine(spark)
    e.register("events", e.spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts")
    plan = e.sql("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00Z'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_interop(spark, tmp_path):
    spec = TableSpec("t", (ColumnSpec("ts", SqlType("TIMESTAMP_NS"), False), ColumnSpec("u", SqlType("UINT64")), ColumnSpec("s", SqlType("SYMBOL")), ColumnSpec("id", SqlType("UUID")), ColumnSpec("d", decimal(20, 8)), ColumnSpec("day", SqlType("DATE"))), "ts")
    df = spark.createDataFrame([(123456789, Decimal(2**64 - 1), "a", bytearray(range(16)), Decimal("1.5"), datetime.date(2024, 1, 1)), (1, None, None, None, None, None)], spec.struct())
    for write, read in ((interop.write_ipc, interop.read_ipc), (interop.write_parquet_file, interop.read_parquet_file)):
        write(df, f"{tmp_path}/x", spec)
        assert read(spark, f"{tmp_path}/x", spec).collect() == df.collect()
    other = TableSpec("t", (ColumnSpec("ts", SqlType("TIMESTAMP_NS"), False),), "ts")
    with pytest.raises(interop.SchemaMismatch):
        interop.read_parquet_file(spark, f"{tmp_path}/x", other)


def change(identity, t, value, weight=1.0, deleted=False):
    return {"grp": "g", "identity": identity, "deleted": deleted, "t": t, "order": t, "value": value, "weight": weight}


def brute(rows, start, width):
    """Figures of a window from its rows (event time, order, identity, value, weight)."""
    mine = sorted(r for r in rows.values() if start <= r[0] < start + width)
    v, n = [r[3] for r in mine], len(mine)
    mean = sum(v) / n if n else None
    m2 = sum((x - mean) ** 2 for x in v) if n else None
    weight = sum(r[4] for r in mine)
    return {"n": n} if not n else {"n": n, "total": sum(v), "least": min(v), "greatest": max(v), "open": v[0], "close": v[-1], "vwap": sum(r[3] * r[4] for r in mine) / weight if weight else None, "var_pop": m2 / n, "var_samp": m2 / (n - 1) if n > 1 else None}


@pytest.mark.parametrize("width,slide", [(30, 30), (40, 10)])
def test_view_against_brute_force(width, slide):
    """Random upserts, moves between windows, tombstones, watermarks and restarts: every change holds the window's figures."""
    rng, v, rows, last, mark = random.Random(width), View(ViewSpec(width, slide, 5)), {}, {}, None
    for position in range(1, 400):
        identity = f"r{rng.randrange(25)}"
        gone = rng.random() < 0.25
        t, value, weight = rng.randrange(-60, 120), rng.uniform(-1e3, 1e3) * 10.0 ** rng.randint(-8, 8), rng.choice([0.0, 0.5, 2.0])
        old = rows.get(identity)
        out = v.commit(position, [change(identity, t, value, weight, gone)])
        rows.pop(identity, None)
        if not gone:
            rows[identity] = (t, t, identity, value, weight)
        touched = {s for x in (old, rows.get(identity)) if x for s in v.spec.windows(x[0])}
        assert [x["window_start"] for x in out] == sorted(touched)
        for x in out:
            want = brute(rows, x["window_start"], width)
            assert {k: x[k] for k in want} == pytest.approx(want) and x["kind"] == ("upsert" if want["n"] else "delete")
            assert x["revision"] == last.get(x["window_start"], 0) + 1
            past = mark is not None and mark >= x["window_start"] + width + 5
            assert x["status"] == (CORRECTED if x["window_start"] in last else FINALIZED if past else PROVISIONAL)
            last[x["window_start"]] = x["revision"]
        if position % 60 == 0:
            mark = position // 4
            for x in v.advance(mark):
                assert x["status"] == FINALIZED and x["window_end"] + 5 <= mark
                last[x["window_start"]] = x["revision"]
            v = View.restore(v.checkpoint())
    with pytest.raises(ViewError, match="gap"):
        v.commit(position + 2, [])
    with pytest.raises(ViewError, match="invalid"):
        v.advance(mark - 1)


def test_view_bounds():
    v = View(ViewSpec(10, 10, max_rows=2, max_windows=2))
    v.commit(1, [change("x", 3, 1.0)])
    v.commit(2, [change("y", 13, 1.0)])
    for bad in (change("z", 4, 1.0), change("y", 25, 1.0)):
        with pytest.raises(ViewError, match="resource_exhausted"):
            v.commit(3, [bad])
    v.commit(3, [change("x", 0, 0, deleted=True), change("z", 14, 1.0)])


def test_view_ends_are_renewed_seldom(monkeypatch):
    """Rows taken away in the order of their times: a window's rows are looked at again once for many of them, not for each."""
    n, looks, renew = 600, [], Window.renew
    monkeypatch.setattr(Window, "renew", lambda self, rows: looks.append(1) or renew(self, rows))
    g = GroupView(ViewSpec(10_000, 10_000), {}, {})
    rows = {str(i): (i, i, str(i), float(i * 7919 % n // 3), 1.0) for i in range(n)}
    for i, r in enumerate(rows.values()):
        g.apply(1, str(i), False, r[0], r[1], r[3], r[4])
    for i in range(n):
        (x,) = g.apply(2, str(i), True, None, None, None, None)
        del rows[str(i)]
        want = brute(rows, 0, 10_000)
        assert {k: x[k] for k in want} == pytest.approx(want)
    assert len(looks) <= n // 100


class MapOfBytes:
    """A map state in memory that forgets nothing it wasn't told to."""

    def __init__(self):
        self.kept = {}

    def containsKey(self, k):
        return k in self.kept

    def getValue(self, k):
        return self.kept[k]

    def updateValue(self, k, v):
        self.kept[k] = v

    def removeKey(self, k):
        del self.kept[k]

    def keys(self):
        return iter(list(self.kept))

    def iterator(self):
        return iter(list(self.kept.items()))


class ValueOfRow:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, v):
        self.kept = v


@pytest.mark.parametrize("width,slide", [(30, 30), (40, 10)])
def test_view_stream_holds_little(monkeypatch, width, slide):
    """Batches of unordered frames with upserts, moves, tombstones and watermarks: the changes are those of brute force in order, and
    neither rows, windows nor changes of a whole batch are held."""
    limits = {"HOLD": 50, "FRAME": 20, "SLICE": 7, "WINDOWS": 3, "BLOCKS": 16, "KEEP": 2, "CUT": 4}
    for k, n in limits.items():
        monkeypatch.setattr(view, k, n, raising=False)
    maps = {}
    handle = SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, MapOfBytes()), getValueState=lambda name, _: maps.setdefault(name, ValueOfRow()))
    held = []
    for c in (view._Map, getattr(view, "_Rows", view._Map)):
        monkeypatch.setattr(c, "flush", lambda self, f=c.flush: held.append(len(self.held)) or f(self))
    rng, rows, last, mark, position = random.Random(width), {}, {}, None, 0
    for batch in range(4):
        given = []
        for _ in range(400):
            position += 1
            identity, gone = f"r{rng.randrange(300)}", rng.random() < 0.4
            given.append(("g", position, identity, "delete" if gone else "upsert", None if gone else rng.randrange(-60, 120), position, rng.randrange(20) / 4, 1.0))
            if position % 150 == 0:
                given.append(("g", position, None, "watermark", position // 20, None, None, None))
        shuffled = rng.sample(given, len(given))
        frames = [pd.DataFrame(shuffled[i : i + 30], columns=["grp", "position", "identity", "kind", "t", "ord", "value", "weight"]) for i in range(0, len(given), 30)]
        p = view.ViewProcessor(ViewSpec(width, slide, 5))
        p.init(handle)
        out = list(p.handleInputRows(("g",), iter(frames), None))
        assert max(map(len, out)) < 2 * limits["FRAME"] and max(held) <= limits["HOLD"]
        out = iter(pd.concat([f.astype(object) for f in out]).to_dict("records"))
        for _, at, identity, kind, t, order, value, weight in given:
            if kind == "watermark":
                mark = t
                for s in sorted(last):
                    if last[s][1] is False and mark >= s + width + 5:
                        last[s] = last[s][0], True
                        if brute(rows, s, width)["n"]:
                            x = next(out)
                            last[s] = x["revision"], True
                            assert (x["window_start"], x["status"]) == (s, FINALIZED)
                continue
            old = rows.pop(identity, None)
            if kind == "upsert":
                rows[identity] = (t, order, identity, value, weight)
            for s in sorted({s for r in (old, rows.get(identity)) if r for s in ViewSpec(width, slide).windows(r[0])}):
                x, want = next(out), brute(rows, s, width)
                assert (x["grp"], x["window_start"], x["position"], x["revision"]) == ("g", s, at, last.get(s, (0,))[0] + 1)
                assert {k: x[k] for k in want if want[k] is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})
                last[s] = x["revision"], last.get(s, (0, False))[1] or mark is not None and mark >= s + width + 5
        assert next(out, None) is None


def test_subscription(eng):
    sub = eng.execute("SUBSCRIBE SELECT symbol, price FROM trades WHERE price > 2.0")
    assert [c.kind for c in sub.poll()] == ["snapshot", "ready"]
    assert sorted(sub.poll()[0].rows) == sorted((s, p) for _, s, p in TRADES if p is not None and p > 2)
    token = sub.ack(2)
    eng.execute(f"INSERT INTO trades (ts, symbol, price) VALUES ({ts(30)}, 'K', 5.0), ({ts(31)}, 'K', 1.0)")
    assert sub.pump() == 1 and sub.poll()[0].rows == [("K", 5.0)] and sub.pump() == 0
    again = SubscriptionLog(eng, sub.sql, eng.token_key, 10, token)
    assert again.pump() == 1 and again.poll()[0].rows == [("K", 5.0)]
    with pytest.raises(SubscriptionError, match="bad_token"):
        SubscriptionLog(eng, sub.sql, b"other", 10, token)
    with pytest.raises(SubscriptionError, match="ineligible"):
        eng.execute("SUBSCRIBE SELECT count(*) AS n FROM trades")


def test_subscription_to_corrections(eng):
    """Tombstones and corrections that leave the filter are told as deletes; buffered changes hold back history compaction."""
    sub = eng.execute("SUBSCRIBE SELECT symbol, price FROM trades WHERE price > 2.0")
    sub.ack(sub.poll()[-1].sequence)
    log, up = eng.logs["trades"], sorted(x for x in TRADES if x[2] is not None and x[2] > 2)[:4]
    ops = list(zip(up, [("correction", 9.0), ("correction", 0.0), ("tombstone", 0.0), ("replacement", None)], strict=True))
    given = [(t, s, p, op) for (t, s, _), (op, p) in ops]
    log.apply(log.spark.createDataFrame(given, "ts long, symbol string, price double, _op string"))
    assert sub.pump() == 1
    put, gone = sub.poll()
    assert (put.kind, gone.kind) == ("upsert", "delete") and put.rows == [(up[0][1], 9.0)]
    assert sorted(gone.rows) == sorted((s, t) for t, s, _ in up[1:])
    log.compact_history(2, log.commits[-1].time_ns)
    assert log.folded <= 1
    sub.ack(gone.sequence)
    log.compact_history(2, log.commits[-1].time_ns)
    assert log.folded == 2 and sub.pump() == 0
    behind = SubscriptionLog(eng, sub.sql, eng.token_key, 1)
    with pytest.raises(SubscriptionError, match="overflow"):
        behind.poll()


def test_commit_order(eng):
    """One admission order over several tables, kept in files."""
    order = CommitOrder(eng.logs, eng.logs["trades"])
    assert [(n, name) for n, name, _ in order.admit()] == [(1, "trades"), (2, "quotes")]
    insert(eng, "trades", [(9, "K", 1.0)], "price")
    assert order.admit() == [(3, "trades", 2)]
    again = CommitOrder(eng.logs, eng.logs["trades"])
    assert again.order == order.order and again.admit() == []


def test_entry_queries_have_sql():
    import __spark_entry__ as e

    from tidemark import queries

    assert set(queries.SQL) == set(queries.QUERIES) and set(queries.QUERIES) <= set(e.queries())
