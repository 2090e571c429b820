"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import body, forget, load, saved, words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens' worth of fixed cost that every sequence has besides its capacity.
OVERHEAD = 64


def n_tokens() -> Column:
    """Default size of a document: its words and one separator."""
    return F.size(words(body())) + 1


class Plan:
    """Best-fit decreasing over a histogram of piece lengths.

    Bins with the same contents are one class with a count, so the plan's size follows the largest capacity, not
    the number of documents; it packs what best-fit decreasing over all the pieces one by one would pack.
    """

    def __init__(self, histogram: dict[int, int], capacities=CAPACITIES, overhead: float = OVERHEAD):
        caps = sorted(capacities)
        self.caps, self.overhead = caps, overhead
        lengths = sorted(histogram)
        mass = np.cumsum([0] + [n * histogram[n] for n in lengths])
        free: list[int] = []  # sorted remaining spaces that some class has
        by: dict[int, list[tuple[int, int, tuple]]] = defaultdict(list)  # remaining -> (capacity, bins, contents)

        def put(rest: int, cls: tuple) -> None:
            if not by[rest]:
                insort(free, rest)
            by[rest].append(cls)

        for at in range(len(lengths) - 1, -1, -1):
            size, n = lengths[at], histogram[lengths[at]]
            while n:
                i = bisect_left(free, size)
                if i < len(free):
                    rest = free[i]
                    cap, bins, had = by[rest].pop()
                    if not by[rest]:
                        free.pop(i)
                else:
                    cap = self._open(size, n, lengths, mass)
                    rest, bins, had = cap, -(-n // (cap // size)), ()
                each = rest // size
                full = min(bins, n // each)
                if full:
                    put(rest - each * size, (cap, full, (*had, (size, each))))
                n -= full * each
                if n and bins > full:
                    put(rest - n * size, (cap, 1, (*had, (size, n))))
                    n, full = 0, full + 1
                if bins > full and had:
                    put(rest, (cap, bins - full, had))
        self.classes = sorted((next(c for c in caps if c >= cap - rest), cap - rest, bins, had) for rest, v in by.items() for cap, bins, had in v)
        rows, base, used = defaultdict(list), 0, defaultdict(int)
        for cap, full, bins, had in self.classes:
            start = 0
            for size, each in had:
                rows[size].append((used[size], each, base, start, cap, full))
                used[size] += bins * each
                start += size * each
            base += bins
        self.bins = base
        self.rows = {size: np.array(v, np.int64).T for size, v in rows.items()}

    def _open(self, size: int, n: int, lengths: list[int], mass: np.ndarray) -> int:
        """The capacity of least cost for each token that the new bins can expect to hold: the pieces at hand, and shorter ones that still fit."""
        best = None
        for cap in self.caps:
            if cap >= size:
                each = cap // size
                bins = -(-n // each)
                left = cap * bins - n * size
                rest = cap - each * size if n >= each else cap - n * size
                shorter = int(mass[min(bisect_left(lengths, size), bisect_left(lengths, rest + 1))])
                cost = bins * (cap + self.overhead) / (n * size + min(left, shorter))
                if best is None or cost < best[0]:
                    best = (cost, cap)
        return best[1]

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """bin, first token in the bin, capacity and filled tokens of the bin, for pieces given by length and rank among their length."""
        out = np.empty((4, len(size)), np.int64)
        for one in np.unique(size):
            i = np.flatnonzero(size == one)
            first, each, base, start, cap, full = self.rows[int(one)]
            k = np.searchsorted(first, rank[i], "right") - 1
            r = rank[i] - first[k]
            out[:, i] = base[k] + r // each[k], start[k] + r % each[k] * one, cap[k], full[k]
        return tuple(out)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the rank among rows of equal length within it; rows come sorted by length."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if len(b):
            n = b.column("length").to_numpy()
            new = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            rank = np.arange(len(n)) - np.repeat(new, np.diff(np.r_[new, len(n)]))
            if n[0] == last:
                rank[: new[1] if len(new) > 1 else len(n)] += seen
            last, seen = n[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank.astype(np.int64))], [*b.schema.names, "part", "rank"])


def pack(docs: DataFrame, capacities=CAPACITIES, overhead: float = OVERHEAD, size: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_pos, capacity, filled): a row for each piece of each document.

    Documents longer than the largest capacity are cut into pieces of that capacity and a rest.  All pieces are packed
    together, longest first, each into the bin it fits best; a new bin takes the capacity of least cost for a token,
    and in the end each bin shrinks to the least capacity that holds it.  Pieces of equal length go by doc_id (nulls first)
    and piece.  Null and empty texts hold the separator alone.  Repeated rows are packed each; an empty table
    gives an empty table.  Only the histogram of lengths (no longer than the largest capacity) goes to the driver.
    """
    spark, top = docs.sparkSession, max(capacities)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (n_tokens() if size is None else size).cast("long").alias("n")).where("n > 0")
    pieces = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))).alias("piece"))
    pieces = saved(pieces.select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * F.lit(top)).cast("long").alias("length")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = pieces.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length", F.col("doc_id").asc_nulls_first(), "piece")
    ranked = saved(ranked.mapInArrow(_ranked, "doc_id long, piece int, start long, length long, part int, rank long"))
    forget(pieces)
    counts = ranked.groupBy("length", "part").count().collect()  # at most lengths + partitions rows: ranges of lengths barely overlap
    histogram, before = defaultdict(int), {}
    for r in sorted(counts):
        before[r["part"], r["length"]] = histogram[r["length"]]
        histogram[r["length"]] += r["count"]
    plan = spark.sparkContext.broadcast((Plan(histogram, capacities, overhead), before))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, base = plan.value
        for b in batches:
            n, part = b.column("length").to_numpy(), b.column("part").to_numpy()
            pair, inverse = np.unique(np.stack([part, n]), axis=1, return_inverse=True)
            rank = b.column("rank").to_numpy() + np.array([base[int(x), int(y)] for x, y in pair.T], np.int64)[inverse.reshape(-1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, p.place(n, rank))], ["doc_id", "piece", "start", "length", "bin_id", "bin_pos", "capacity", "filled"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, bin_id long, bin_pos long, capacity long, filled long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"))
