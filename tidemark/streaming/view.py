"""Windowed views kept up over commits: tumbling and sliding windows with corrections."""

from __future__ import annotations

import heapq
import math
import os
import pickle
import tempfile
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator, MutableMapping
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVISIONAL, FINALIZED, CORRECTED = "provisional", "finalized", "corrected"
#: Columns of a change (fixed order).
CHANGE = "grp string, window_start long, window_end long, revision long, kind string, status string, position long, n long, total double, least double, greatest double, vwap double, open double, high double, low double, close double, var_pop double, var_samp double"


class ViewError(Exception):
    """code: invalid resource_exhausted gap."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class ViewSpec:
    width: int
    slide: int
    lateness: int = 0
    max_windows: int = 1 << 30
    max_rows: int = 1 << 30

    def __post_init__(self):
        if self.width <= 0 or self.slide <= 0 or self.width % self.slide or self.lateness < 0:
            raise ViewError("invalid", "the width is a positive multiple of the slide, and lateness isn't negative")

    def windows(self, t: int) -> range:
        """Starts of the windows that hold t."""
        last = t - t % self.slide
        return range(last - self.width + self.slide, last + 1, self.slide)


#: Every finite double is a whole number of 2**-SCALE.
SCALE = 1074
#: Keys kept of each end of a window, after a cut and before it.
KEEP, CUT = 128, 256
#: Input rows of a group that are held and written at once; windows held; changes in a frame of output; rows read at once of a sorted run.
HOLD, WINDOWS, FRAME, SLICE = 200_000, 256, 10_000, 1_000
#: A group's rows lie in so many blocks of the state store at most.
BLOCKS = 1 << 14


def _exact(x: float) -> int:
    n, d = float(x).as_integer_ratio()
    return n << (SCALE - d.bit_length() + 1)


class End:
    """The least or greatest (`top`) keys of a window with their counts: all from the outermost to the last one kept, or all there
    are (`whole`).  Keys further in are only counted by the window, so an end whose kept keys are all removed has to be renewed."""

    __slots__ = ("counts", "keys", "top", "whole")

    def __init__(self, top: bool):
        self.top, self.whole, self.keys, self.counts = top, True, [], {}

    def outermost(self):
        return self.keys[-1 if self.top else 0] if self.keys else None

    def add(self, k) -> None:
        if not self.whole and (not self.keys or (k < self.keys[0] if self.top else k > self.keys[-1])):
            return
        if k in self.counts:
            self.counts[k] += 1
            return
        self.counts[k] = 1
        insort(self.keys, k)
        if len(self.keys) > CUT:
            self.whole = False
            self.keys = self.keys[-KEEP:] if self.top else self.keys[:KEEP]
            self.counts = {x: self.counts[x] for x in self.keys}

    def remove(self, k) -> None:
        n = self.counts.get(k, 0)
        if n > 1:
            self.counts[k] = n - 1
        elif n:
            del self.counts[k]
            del self.keys[bisect_left(self.keys, k)]


class Window:
    """What is kept of one window: exact sums, from which rows can be taken away again, and the ends of its values and times.

    Sums are whole numbers of 2**-SCALE (products: of its square), so adding and removing in any order gives the same figures.
    Taking the last kept key of an end away makes the ends stale; they are then looked up among the window's rows."""

    __slots__ = ("emitted", "ends", "final", "n", "products", "revision", "squares", "total", "weight")

    def __init__(self):
        self.revision = self.n = self.total = self.weight = self.products = self.squares = 0
        self.emitted = self.final = False
        self.clear()

    def clear(self) -> None:
        self.ends = (End(False), End(True), End(False), End(True))

    @property
    def stale(self) -> bool:
        return self.n > 0 and not all(e.keys for e in self.ends)

    def count(self, row: tuple, sign: int) -> None:
        value, weight = _exact(row[3]), _exact(row[4])
        self.n += sign
        self.total += sign * value
        self.weight += sign * weight
        self.products += sign * value * weight
        self.squares += sign * value * value

    def _mark(self, row: tuple) -> None:
        least, greatest, first, last = self.ends
        at = row[:4]
        least.add(row[3])
        greatest.add(row[3])
        first.add(at)
        last.add(at)

    def add(self, row: tuple) -> None:
        """row: (event time, order, identity, value, weight)."""
        self.count(row, 1)
        self._mark(row)

    def remove(self, row: tuple) -> None:
        self.count(row, -1)
        if not self.n:
            self.clear()
            return
        for e, k in zip(self.ends, (row[3], row[3], row[:4], row[:4]), strict=True):
            e.remove(k)

    def renew(self, rows: Iterable[tuple]) -> None:
        """Ends from the window's rows."""
        self.clear()
        for r in rows:
            self._mark(r)

    def figures(self) -> dict:
        n = self.n
        if not n:
            return dict.fromkeys(("total", "least", "greatest", "vwap", "open", "high", "low", "close", "var_pop", "var_samp")) | {"n": 0}
        least, greatest, first, last = (e.outermost() for e in self.ends)
        spread = n * self.squares - self.total * self.total  # n squared times the variance
        return {
            "n": n, "total": self.total / (1 << SCALE), "least": least, "greatest": greatest, "vwap": self.products / (self.weight << SCALE) if self.weight else None,
            "open": first[3], "high": greatest, "low": least, "close": last[3], "var_pop": spread / (n * n << 2 * SCALE), "var_samp": spread / (n * (n - 1) << 2 * SCALE) if n > 1 else None,
        }


class GroupView:
    """State of one group over two mappings: identity -> (event time, order, identity, value, weight), and window start ->
    Window.  The mappings may be dicts or state-store maps; sizes are counted in `sizes` (rows, windows)."""

    def __init__(self, spec: ViewSpec, rows: MutableMapping, windows: MutableMapping, watermark: int | None = None, position: int = 0, sizes: tuple[int, int] | None = None):
        self.spec, self.rows, self.windows, self.watermark, self.position = spec, rows, windows, watermark, position
        self.n_rows, self.n_windows = sizes if sizes is not None else (len(rows), len(windows))

    def _past(self, start: int) -> bool:
        return self.watermark is not None and self.watermark >= start + self.spec.width + self.spec.lateness

    def _row(self, start: int, w: Window, status: str, position: int) -> dict:
        if w.stale:
            w.renew(r for r in self.rows.values() if start <= r[0] < start + self.spec.width)
        w.revision, w.emitted = w.revision + 1, True
        self.windows[start] = w
        return {"window_start": start, "window_end": start + self.spec.width, "revision": w.revision, "kind": "upsert" if w.n else "delete", "status": status, "position": position} | w.figures()

    def apply(self, position: int, identity: str, deleted: bool, t: int | None, order: int | None, value: float | None, weight: float | None) -> list[dict]:
        """One row change; the changes of the windows it touches, by start.  A late row is taken as a correction, never dropped.
        Positions never go back."""
        if position < self.position:
            raise ViewError("gap", f"position {position} after {self.position}")
        old, new = self.rows.get(identity), None
        if not deleted:
            if not (math.isfinite(value) and math.isfinite(weight)):
                raise ViewError("invalid", "values and weights are finite")
            new = (t, order, identity, value, weight)
        elif old is None:
            self.position = position
            return []
        starts = {s for r in (old, new) if r for s in self.spec.windows(r[0])}
        touched = {s: self.windows.get(s) for s in starts}
        fresh = sum(w is None for w in touched.values())
        if old is None and self.n_rows >= self.spec.max_rows:
            raise ViewError("resource_exhausted", "too many rows")
        if fresh + self.n_windows > self.spec.max_windows:
            raise ViewError("resource_exhausted", "too many windows")
        self.position = position
        self.n_windows += fresh
        self.n_rows += (old is None) - deleted
        touched = {s: w or Window() for s, w in touched.items()}
        for s, w in touched.items():
            if old and s <= old[0] < s + self.spec.width:
                w.remove(old)
            if new and s <= new[0] < s + self.spec.width:
                w.add(new)
        if deleted:
            del self.rows[identity]
        else:
            self.rows[identity] = new
        out = []
        for s, w in sorted(touched.items()):
            status = CORRECTED if w.emitted else FINALIZED if self._past(s) else PROVISIONAL
            w.final = w.final or self._past(s)
            out.append(self._row(s, w, status, position))
        return out

    def advance(self, position: int, watermark: int) -> list[dict]:
        """A watermark: windows that end, with the lateness, at or before it are final.  Empty ones go final in silence."""
        if self.watermark is not None and watermark < self.watermark:
            raise ViewError("invalid", "a watermark can't go back")
        self.watermark = watermark
        out = []
        for s in sorted(self.windows):
            if self._past(s) and not (w := self.windows[s]).final:
                w.final = True
                if w.n:
                    out.append(self._row(s, w, FINALIZED, position))
                else:
                    self.windows[s] = w
        return out


class View:
    """A view in one process: the model that the streaming form is tested against, and a checkpointable local view."""

    def __init__(self, spec: ViewSpec):
        self.spec, self.position, self.groups, self.watermark = spec, 0, {}, None

    def commit(self, position: int, changes: list[dict]) -> list[dict]:
        """changes: grp, identity, deleted, t, order, value, weight.  Positions follow each other without gaps."""
        if position != self.position + 1:
            raise ViewError("gap", f"position {position} after {self.position}")
        out = []
        saved = self.checkpoint()
        try:
            for c in changes:
                g = self.groups.setdefault(c["grp"], GroupView(self.spec, {}, {}, self.watermark))
                out += [{"grp": c["grp"]} | x for x in g.apply(position, c["identity"], c["deleted"], c["t"], c["order"], c["value"], c["weight"])]
        except ViewError:
            self.__dict__.update(View.restore(saved).__dict__)
            raise
        self.position = position
        return out

    def advance(self, watermark: int) -> list[dict]:
        if self.watermark is not None and watermark < self.watermark:
            raise ViewError("invalid", "a watermark can't go back")
        self.watermark = watermark
        return [{"grp": k} | x for k, g in sorted(self.groups.items()) for x in g.advance(self.position, watermark)]

    def checkpoint(self) -> bytes:
        return pickle.dumps((self.spec, self.position, self.watermark, {k: (dict(g.rows), dict(g.windows), g.watermark) for k, g in self.groups.items()}))

    @staticmethod
    def restore(data: bytes) -> View:
        spec, position, watermark, groups = pickle.loads(data)
        v = View(spec)
        v.position, v.watermark = position, watermark
        for k, (rows, windows, w) in groups.items():
            for s, x in windows.items():  # sums must be those of the window's rows
                own = Window()
                for r in rows.values():
                    if s <= r[0] < s + spec.width:
                        own.count(r, 1)
                if (own.n, own.total, own.weight, own.products, own.squares) != (x.n, x.total, x.weight, x.products, x.squares):
                    raise ViewError("invalid", "the checkpoint contradicts itself")
            v.groups[k] = GroupView(spec, rows, windows, w, position)
        return v


class _Map(MutableMapping):
    """A state-store map of pickled values.  What is touched is held until flush(), or until WINDOWS others are."""

    def __init__(self, state):
        self.state, self.held, self.dirty = state, {}, set()

    def __getitem__(self, k):
        if k not in self.held:
            if len(self.held) >= WINDOWS:
                self.flush()
            v = self.state.getValue((k,)) if self.state.containsKey((k,)) else None
            self.held[k] = None if v is None else pickle.loads(v[0])
        if self.held[k] is None:
            raise KeyError(k)
        return self.held[k]

    def __setitem__(self, k, v):
        self.held[k] = v
        self.dirty.add(k)

    def __delitem__(self, k):
        self[k] = None

    def __iter__(self):
        stored = {k for (k,) in self.state.keys()}  # noqa: SIM118
        return iter([k for k in stored | self.held.keys() if self.held.get(k, k) is not None])

    def __len__(self):
        return sum(1 for _ in self)

    def flush(self) -> None:
        for k in self.dirty:
            v = self.held[k]
            if v is not None:
                self.state.updateValue((k,), (pickle.dumps(v),))
            elif self.state.containsKey((k,)):
                self.state.removeKey((k,))
        self.held, self.dirty = {}, set()


class _Rows(MutableMapping):
    """A group's rows by identity, in blocks of a state-store map.  Only rows of the identities given to fetch() are held, until flush();
    others are read for values() alone, block by block."""

    def __init__(self, state):
        self.state, self.held, self.dirty = state, {}, set()

    def _blocks(self, identities: Iterable) -> Iterator[tuple[int, list, dict]]:
        """(number, identities, rows) of the blocks that identities belong to."""
        dealt = defaultdict(list)
        for i in identities:
            dealt[zlib.crc32(str(i).encode("utf-8", "surrogatepass")) % BLOCKS].append(i)
        for b, mine in dealt.items():
            yield b, mine, self._block(b)

    def _block(self, b: int) -> dict:
        return pickle.loads(self.state.getValue((b,))[0]) if self.state.containsKey((b,)) else {}

    def fetch(self, identities: Iterable) -> None:
        for _, mine, block in self._blocks(set(identities) - self.held.keys()):
            self.held.update((i, block.get(i)) for i in mine)

    def __getitem__(self, k):
        if k not in self.held:
            self.fetch([k])
        if self.held[k] is None:
            raise KeyError(k)
        return self.held[k]

    def __setitem__(self, k, v):
        self.held[k] = v
        self.dirty.add(k)

    def __delitem__(self, k):
        self[k] = None

    def items(self) -> Iterator[tuple]:
        for b in [b for (b,) in self.state.keys()]:  # noqa: SIM118
            yield from ((k, v) for k, v in self._block(b).items() if k not in self.held)
        yield from ((k, v) for k, v in self.held.items() if v is not None)

    def values(self) -> Iterator[tuple]:
        return (v for _, v in self.items())

    def __iter__(self):
        return (k for k, _ in self.items())

    def __len__(self):
        return sum(1 for _ in self)

    def flush(self) -> None:
        for b, mine, block in self._blocks(self.dirty):
            found = bool(block)
            for i in mine:
                if self.held[i] is None:
                    block.pop(i, None)
                else:
                    block[i] = self.held[i]
            if block:
                self.state.updateValue((b,), (pickle.dumps(block),))
            elif found:
                self.state.removeKey((b,))
        self.held, self.dirty = {}, set()


def _whole(c: pd.Series) -> list:
    """Whole numbers of a column, None where there are none."""
    return c.tolist() if c.dtype.kind == "i" else [None if gone else int(x) for x, gone in zip(c, c.isna(), strict=True)]


def _inputs(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(position, ord, identity, kind, t, value, weight) of each input row."""
    for f in frames:
        yield from zip(_whole(f["position"]), _whole(f["ord"]), f["identity"], f["kind"], _whole(f["t"]), f["value"], f["weight"], strict=True)


def _turn(r: tuple) -> tuple:
    """Rows go by position and order, rows without an order last."""
    return r[0], r[1] is None, r[1] or 0


def _sorted(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows by _turn(), equal ones as they came.  Runs of HOLD rows are sorted and written to a file of this task, which goes when it is
    closed, and merged from there."""
    run = sorted(islice(rows, HOLD), key=_turn)
    if len(run) < HOLD:
        yield from run
        return
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:

        def read(at: list[int]) -> Iterator[tuple]:
            for x in at:
                file.seek(x)
                yield from pickle.load(file)

        runs = []
        while run:
            at = []
            for i in range(0, len(run), SLICE):
                at.append(file.tell())
                pickle.dump(run[i : i + SLICE], file)
            runs.append(at)
            del run
            run = sorted(islice(rows, HOLD), key=_turn)
        yield from heapq.merge(*map(read, runs), key=_turn)


class ViewProcessor(StatefulProcessor):
    """Keyed by group.  Input rows: grp, position, identity, kind ('upsert', 'delete', 'watermark'), t, ord, value, weight; watermarks
    come as rows for each group, since Spark's own watermark would drop late rows.

    A group's rows of a batch are sorted outside memory and applied HOLD at a time; what they touch is read before and written after."""

    def __init__(self, spec: ViewSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("blocks", "block long", "v binary")
        self.windows = handle.getMapState("windows", "start long", "v binary")
        self.mark = handle.getValueState("mark", "watermark long, position long, n_rows long, n_windows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, position, *sizes = self.mark.get() if self.mark.exists() else (None, 0, 0, 0)
        kept, windows = _Rows(self.rows), _Map(self.windows)
        g, out = GroupView(self.spec, kept, windows, mark, position, tuple(sizes)), []
        names = [x.strip().split(" ")[0] for x in CHANGE.split(",")]
        turns = _sorted(_inputs(rows))
        while held := list(islice(turns, HOLD)):
            kept.fetch(r[2] for r in held if r[3] != "watermark")
            for at, order, identity, kind, t, value, weight in held:
                out += g.advance(at, t) if kind == "watermark" else g.apply(at, identity, kind == "delete", t, order, value, weight)
                if len(out) >= FRAME:
                    yield pd.DataFrame([{"grp": key[0]} | x for x in out], columns=names)
                    out = []
            kept.flush()
            held.clear()
        windows.flush()
        self.mark.update((g.watermark, g.position, g.n_rows, g.n_windows))
        yield pd.DataFrame([{"grp": key[0]} | x for x in out], columns=names)

    def close(self) -> None:
        """Nothing is held open."""


def stream_view(changes: DataFrame, spec: ViewSpec) -> DataFrame:
    """Change log of a view over a stream of input rows (see ViewProcessor).  State lives in the RocksDB state store, checkpointed by Spark."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return changes.groupBy("grp").transformWithStateInPandas(ViewProcessor(spec), CHANGE, "Update", "None")


def batch_view(rows: DataFrame, spec: ViewSpec) -> DataFrame:
    """(grp, window_start, aggregates) of visible rows (grp, identity, t, ord, value, weight): what a view's last upserts come to.

    Rows are summed by slide first; a window adds its width / slide sums, so only those are repeated and shuffled again."""
    pieces = spec.width // spec.slide
    at, value, weight = F.struct("t", "ord", "identity"), F.col("value"), F.col("weight")
    one = rows.withColumn("slot", F.col("t") - F.pmod("t", F.lit(spec.slide))).groupBy("grp", "slot").agg(
        F.count("*").alias("n"), F.count("value").alias("k"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum("weight").alias("weight"), F.sum(value * weight).alias("products"),
        F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"),
    )
    if pieces == 1:
        w = one.withColumnRenamed("slot", "window_start")
        var_samp = F.when(F.col("n") > 1, F.col("var") * F.col("k") / (F.col("k") - 1))
        vwap = F.when(F.col("weight") != 0, F.col("products") / F.col("weight"))
        return w.select("grp", "window_start", "n", "total", "least", "greatest", vwap.alias("vwap"), "open", "close", F.col("var").alias("var_pop"), var_samp.alias("var_samp"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.col("slot") - i * F.lit(spec.slide))
    w = one.withColumn("window_start", F.explode(starts))
    k, mean = F.sum("k"), F.sum(F.col("k") * F.col("mean")) / F.sum("k")
    # squared distances inside the slides and between their means
    inner = F.sum(F.col("k") * F.col("var"))
    out = w.groupBy("grp", "window_start").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.when(F.sum("weight") != 0, F.sum("products") / F.sum("weight")).alias("vwap"), F.min_by("open", "first").alias("open"), F.max_by("close", "last").alias("close"),
        k.alias("k"), mean.alias("mean"), inner.alias("inner"), F.collect_list(F.struct("k", "mean")).alias("parts"),
    )
    between = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.coalesce(p["k"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)))
    m2 = F.col("inner") + between
    return out.select("grp", "window_start", "n", "total", "least", "greatest", "vwap", "open", "close", (m2 / F.col("k")).alias("var_pop"), F.when(F.col("n") > 1, m2 / (F.col("k") - 1)).alias("var_samp"))
