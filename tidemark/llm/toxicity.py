"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import body, load, saved

#: Labelled examples in the index, at most: those with the least hashes of their doc_id.
EXAMPLES = 6_000
#: Nearest examples that vote; weight of the base rate among their votes; examples in a block, in a small index and in that of train().
NEAREST, PRIOR, BLOCK, WIDE = 50, 0.5, 64, 1_024
#: A term of one in COMMON examples or more has its weights as a row of all places; the commonest ROWS terms at most.  Texts in a product.
COMMON, ROWS, AT_ONCE = 8, 256, 64
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def counted(text: str) -> Counter:
    """Occurrences of each lower-cased word of the whole text."""
    return Counter(_WORD.findall(text.lower()))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] to start[i] + size[i] - 1 of every i, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class BlockMaxIndex:
    """Postings by term and block of examples, with the largest weight of each term in each block.

    A term's postings in a block lie together, so a block that isn't wanted is never read.  `read` counts postings read."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: np.ndarray, wide: int = BLOCK):
        """examples: doc_id, label, sorted terms and their counts.  weights: of each term.  wide: examples in a block, 65,536 at most."""
        self.weights, self.read, self.wide = weights, 0, wide
        rows = []
        for doc, label, terms, counts in examples:
            t, w = self.vector(terms, counts)
            # examples with the same strongest term stand together, so that blocks differ in their bounds
            rows.append((int(t[w.argmax()]) if len(t) else len(weights), doc, label, t, w))
        rows.sort(key=lambda r: r[:2])
        self.docs = np.array([r[1] for r in rows], np.int64)
        self.labels = np.array([r[2] for r in rows], np.float64)
        term = np.concatenate([r[3] for r in rows]) if rows else np.empty(0, np.int64)
        weight = np.concatenate([r[4] for r in rows]) if rows else np.empty(0)
        row = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        order = np.lexsort((row, term))  # rows of a block are neighbours
        term, row, self.weight = term[order], row[order], weight[order]
        block = row // wide
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.empty(0, np.int64)
        # narrow types, since each executor holds a copy: a posting is its row in the block and its weight
        self.row = (row % wide).astype(np.uint16)
        #: an entry for each term and block: where its postings start, its block, its largest weight, rounded up
        self.start, self.block = np.r_[new, len(term)].astype(np.int32), block[new].astype(np.int16)
        most = np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(2))
        self.entry = np.searchsorted(term[new], np.arange(len(weights) + 1)).astype(np.int32)
        self.blocks = -(-len(rows) // wide)
        # base rate of all examples: what a text without any term of the space has to go by
        self.base = float(self.labels.mean()) if rows else 0.5
        self._fill()

    def _fill(self) -> None:
        """The rows of the postings as places in all scores, and rows of common terms: made where the index is used, and never sent."""
        self.place = np.repeat(self.block.astype(np.int64) * self.wide, np.diff(self.start)) + self.row
        at = self.start[self.entry]
        df = np.diff(at)
        common = np.flatnonzero(COMMON * df >= max(1, len(self.docs)))
        common = common[np.argsort(-df[common], kind="stable")[:ROWS]]
        self.dense = np.full(len(df), -1, np.int32)  # of each term: its row, if it has one
        self.dense[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks * self.wide))
        for i, t in enumerate(common.tolist()):
            self.rows[i, self.place[at[t] : at[t + 1]]] = self.weight[at[t] : at[t + 1]]

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k not in ("place", "dense", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a weight above 0, and weights of length 1."""
        w = (1 + np.log(counts)) * self.weights[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / math.sqrt(float(w @ w)) if len(w) else w

    def common(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """For each text, what its common terms give to the scores of all places: one product for AT_ONCE texts, of one shape always."""
        for k in range(0, len(texts), AT_ONCE):
            share, some = np.zeros((AT_ONCE, len(self.rows))), texts[k : k + AT_ONCE]
            for i, x in enumerate(some):
                t, w = self.vector(*x)
                line = self.dense[t]
                share[i, line[line >= 0]] = w[line >= 0]
            yield from (share @ self.rows)[: len(some)]

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEAREST, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0; ties go to the smaller row.

        Scores start from the common terms' part.  The other terms' blocks are read by falling bound, until no block left can hold one of
        the k best: what such a block has so far is below those."""
        t, w = self.vector(terms, counts)
        if not len(t) or not self.blocks:
            return np.empty(0, np.int64), np.empty(0)
        score = next(self.common([(terms, counts)])) if common is None else common
        rare = self.dense[t] < 0
        t, w = t[rare], w[rare]
        n = (self.entry[t + 1] - self.entry[t]).astype(np.int64)
        entry, weight = _ranges(self.entry[t], n), np.repeat(w, n)
        block = self.block[entry].astype(np.int64)
        bound = np.bincount(block, weight * self.most[entry], self.blocks) + score.reshape(self.blocks, -1).max(1)
        order = np.argsort(-bound, kind="stable")
        taken, least, step = 0, 0.0, 1
        while taken < len(order) and bound[order[taken]] > 0 and bound[order[taken]] >= least - 1e-12:
            use = np.zeros(self.blocks, bool)
            use[order[taken : taken + step]] = True
            if least:
                use &= bound >= least - 1e-12
            mine = np.flatnonzero(use[block])
            e = entry[mine]
            size = (self.start[e + 1] - self.start[e]).astype(np.int64)
            self.read += int(size.sum())
            at = _ranges(self.start[e].astype(np.int64), size)
            score = score + np.bincount(self.place[at], self.weight[at] * np.repeat(weight[mine], size), len(score))
            taken, step = taken + step, step * 8
            if taken < len(order) and len(score) >= k:
                least = float(np.partition(score, len(score) - k)[len(score) - k])
        score = score.round(12)  # equal examples are ties, however their products were summed
        if len(score) >= k:
            least = float(np.partition(score, len(score) - k)[len(score) - k])
        top = np.flatnonzero((score > 0) & (score >= least))
        top = top[np.lexsort((top, -score[top]))[:k]]
        return top, score[top]

    def vote(self, rows: np.ndarray, sim: np.ndarray) -> float:
        return float((sim @ self.labels[rows] + PRIOR * self.base) / (sim.sum() + PRIOR))


class Calibration:
    """Monotone map from votes to the share of label 1, fitted on (vote of the others, label) of the examples (pooled adjacent violators)."""

    def __init__(self, pairs: list[tuple[float, int]], base: float):
        sums: dict[float, list[float]] = {}
        for v, y in pairs:
            p = sums.setdefault(v, [v, v, 0.0, 0.0])
            p[2] += y
            p[3] += 1
        out: list[list[float]] = []
        for _, p in sorted(sums.items()):
            out.append(p)
            while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
                last = out.pop()
                out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
        x = [z for lo, hi, _, _ in out for z in (lo, hi)] or [0.0, 1.0]
        y = [(s + base) / (n + 1) for _, _, s, n in out for _ in (0, 1)] or [0.0, 1.0]
        self.levels = (np.array(x), np.maximum.accumulate(np.array(y)))

    def score(self, vote: float) -> float:
        """Calibrated, with a small share of the vote itself so that votes on one level stay in order."""
        return min(1.0, max(0.0, 0.98 * float(np.interp(vote, *self.levels)) + 0.02 * vote))


@dataclass
class Model:
    """What workers need: the numbers of the words and the index as broadcasts, each sent once, and the calibration."""

    number: Broadcast
    index: Broadcast
    calibration: Calibration


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Iterator[str]]]:
    for b in batches:
        yield b, (x.as_py() or "" for x in b.column(column))


def _numbered(number: dict[str, int], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the text's known words, and their counts."""
    words = _WORD.findall(text.lower())
    t, n = np.unique(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)), return_counts=True)
    known = np.searchsorted(t, 0)  # unknown words come first
    return t[known:], n[known:].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Index and calibration from labels (doc_id, toxic) of docs.

    The space has every word of the examples.  A word weighs its inverse document frequency, counted over all docs, times
    the root of its chi-square with the label among the examples (1 where the examples have one label only): words without
    any bearing on the label weigh little, but none is dropped.  Of rows that share a doc_id the least text and the
    largest label count; null labels are left out."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    pick = rows.orderBy(F.xxhash64("_d"), "_d").limit(examples)
    sample = docs.select(F.col("doc_id").cast("long").alias("_i"), body().alias("_t")).join(F.broadcast(pick), F.col("_i") == F.col("_d"))
    sample = saved(sample.groupBy("_d", "y").agg(F.min("_t").alias("text")))

    def words(batches):
        for b, texts in _texts(batches):
            found = [sorted(counted(t)) for t in texts]
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(found)), pa.string()), pa.array(np.repeat(b.column("y").to_numpy(), n).astype(np.int32))], ["term", "y"])

    n1, n0 = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    known = sample.mapInArrow(words, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).toArrow()  # words of the examples
    order = np.argsort(known.column("term").to_numpy(zero_copy_only=False))
    vocabulary = known.column("term").take(pa.array(order)).to_pylist()
    a, b = (known.column(c).to_numpy()[order].astype(float) for c in "ab")
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def frequencies(batches):
        """Rows of the words that this task met: one each, summed over its documents."""
        number, total, n = shared.value, np.zeros(len(shared.value) + 1, np.int64), 0
        for b, texts in _texts(batches):
            n += len(b)
            for t in texts:
                found = set(_WORD.findall(t.lower()))
                total[np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))] += 1  # the last counts unknown words
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array(np.r_[total[some], n])], ["term", "df"])

    counts = docs.select(body().alias("text")).mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df, total = counts.column("term").to_numpy(), counts.column("df").to_numpy(), np.zeros(len(vocabulary))
    total[term[term >= 0]] = df[term >= 0]
    weights = np.log((1 + df[term < 0].sum()) / (1 + total)) + 1
    if n0 and n1:
        n = n0 + n1
        weights *= np.sqrt(n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * n1 * n0, 1))

    def vectors(batches):
        for b, texts in _texts(batches):
            both = [_numbered(shared.value, t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("y"), pa.array([x for x, _ in both], pa.list_(pa.int64())), pa.array([x for _, x in both], pa.list_(pa.float64()))], ["d", "y", "t", "c"])

    each = saved(sample.select("_d", "y", "text").mapInArrow(vectors, "d long, y int, t array<long>, c array<double>"))
    held = each.orderBy("d").toArrow()  # EXAMPLES rows at most
    index = BlockMaxIndex([(d.as_py(), y.as_py(), t.values.to_numpy(), c.values.to_numpy()) for d, y, t, c in zip(*(held.column(x) for x in "dytc"), strict=True)], weights, WIDE)
    trained = spark.sparkContext.broadcast(index)

    def votes(batches):
        """Each example's vote of the others."""
        index = trained.value
        place = {d: i for i, d in enumerate(index.docs.tolist())}
        for b in batches:
            out, each = [], [(t.values.to_numpy(), c.values.to_numpy()) for t, c in zip(b.column("t"), b.column("c"), strict=True)]
            for d, x, common in zip(b.column("d"), each, index.common(each), strict=True):
                rows, sim = index.nearest(*x, NEAREST + 1, common)
                other = rows != place[d.as_py()]
                out.append(index.vote(rows[other][:NEAREST], sim[other][:NEAREST]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), b.column("y")], ["vote", "y"])

    pairs = [(r["vote"], r["y"]) for r in each.mapInArrow(votes, "vote double, y int").collect()]  # EXAMPLES rows at most
    return Model(shared, trained, Calibration(pairs, index.base))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence array<long>, words array<string>): a row per document.

    The nearest examples vote with their cosines; evidence holds the doc_ids of the first three, words the known words of
    the text that weigh most.  Texts without a known word (null and empty ones too) get the base rate's score.  Rows are
    scored one by one, so repeats get equal scores; an empty table gives an empty table."""
    number_, index_, calibration = model.number, model.index, model.calibration

    def run(batches):
        number, index = number_.value, index_.value
        vocabulary = list(number)  # in the order of the numbers
        for b, texts in _texts(batches):
            scores, evidence, words = [], [], []
            for some in batched(texts, AT_ONCE):
                each = [_numbered(number, text) for text in some]
                for (terms, counts), common in zip(each, index.common(each), strict=True):
                    rows, sim = index.nearest(terms, counts, NEAREST, common)
                    scores.append(calibration.score(index.vote(rows, sim)))
                    evidence.append(index.docs[rows[:3]].tolist())
                    t, w = index.vector(terms, counts)
                    words.append([vocabulary[x] for x in t[np.lexsort((t, -w))[:3]].tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], ["doc_id", "score", "evidence", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<long>, words array<string>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = train(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic").where(part != 1))
    out = toxicity(docs, model)
    return out.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
