"""Substring dedup: passages that occur twice, found by FM-indexes of co-located passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPLIT, body, forget, load, release, restored, saved, words
from tidemark.llm.fm_index import FMIndex

#: Words of an anchor; each window of `width` words has one, the least by hash of those inside it.
GRAM = 16
#: Words whose anchors are sought at a time, at most; a power of two.
PART = 1 << 22
#: Words that a shard's index takes, about.
SHARD_WORDS = 150_000
#: Anchors with more distinct passages than this are indexed window by window, as are those with more than a share of
#: 1 / PARTS of all passages; the latter, PARTS at most, are told by a broadcast instead of a shuffle on the anchor.
HOT, PARTS = 2_000, 10_000
#: Parts that the passages of a common window are dealt to in the join on the window.
SALTS = 8


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width]; the last width - 1 entries are of shorter stretches and not to be used."""
    m, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        m[:-step] = np.minimum(m[:-step], m[step:])
        have += step
    return m


def anchor_runs(hashes: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor, lo, hi): windows lo to hi of the document share the anchor, the leftmost least gram in each."""
    n = len(hashes)
    if n < width:
        return (np.empty(0, np.int64),) * 4
    if n > PART:  # one text alone: parts that share width - 1 words hold each window once
        cut = [(a, anchor_runs(hashes[a : a + PART], np.array([0, len(hashes[a : a + PART])]), width, gram)) for a in range(0, n - width + 1, PART - width + 1)]
        return tuple(np.concatenate(x) for x in zip(*((d, h, lo + a, hi + a) for a, (d, h, lo, hi) in cut), strict=True))
    with np.errstate(over="ignore"):
        h, have, power = hashes.copy(), 1, np.uint64(0x9E3779B97F4A7C15)
        while have < gram:  # gram is a power of two
            nxt = h * power
            nxt[:-have] += h[have:]
            h, power, have = nxt, power * power, have * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    key = (h & ~np.uint64(PART - 1)) | np.arange(n, dtype=np.uint64)
    at = (_sliding_min(key, width - gram + 1) & np.uint64(PART - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.zeros(n, bool)
    ok[: n - width + 1] = doc[: n - width + 1] == doc[width - 1 :]
    s = np.flatnonzero(ok)
    if not len(s):
        return (np.empty(0, np.int64),) * 4
    new = np.flatnonzero(np.r_[True, (at[s[1:]] != at[s[:-1]]) | (doc[s[1:]] != doc[s[:-1]])])
    lo, hi = s[new], s[np.r_[new[1:], len(s)] - 1]
    return doc[lo], h[at[lo]].view(np.int64), lo - offsets[doc[lo]], hi - offsets[doc[lo]]


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists, ids, th = b.column(2), b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        first = 0
        while first < len(b):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 19), "right")) - 1)
            last = min(last, len(b))
            doc, anchor, lo, hi = anchor_runs(values[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column(0).take(pa.array(doc + first)), pa.array(th[doc + first]), pa.array((lo << 32) | hi)], ["anchor", "doc_id", "th", "run"])
            first = last


def _search(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """A shard: indexes its passages, streams each through the index, and reports the intervals that occur twice or more.

    A passage stands for n equal ones; it goes into the index once or, for two and more, twice."""
    split = [t.split(" ") for t in pdf["passage"]]
    twice = np.repeat(np.arange(len(split)), np.minimum(pdf["n"].to_numpy(), 2))
    size = np.array([len(x) for x in split], np.int64)
    ids: dict[str, int] = {}
    symbols = [np.array([ids.setdefault(w, len(ids) + 1) for w in x] + [0], np.int64) for x in split]
    del split
    text = np.concatenate([symbols[i] for i in twice])
    start = np.zeros(len(size), np.int64)
    start[twice[::-1]] = (np.cumsum(size[twice] + 1) - size[twice] - 1)[::-1]  # of its first copy
    index = FMIndex(text, width + 1)
    count = size - width + 1
    owner = np.repeat(np.arange(len(size)), count)
    begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    hit = index.matching(text, start[owner] + begin + width - 1, width) >= width
    owner, begin = owner[hit], begin[hit]
    if not len(owner):
        return pd.DataFrame({"anchor": [], "p1": [], "p2": [], "lo": [], "hi": []}).astype("int64")
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] > begin[:-1] + width)])
    key = {c: pdf[c].to_numpy()[owner[new]] for c in ("anchor", "p1", "p2")}
    return pd.DataFrame(key | {"lo": begin[new], "hi": begin[np.r_[new[1:], len(begin)] - 1] + width})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])))
def _stretches(n: pd.Series, covered: pd.Series) -> pd.Series:
    """Stretches of words that no interval covers."""
    out = []
    for size, iv in zip(n, covered, strict=True):
        at, left = 0, []
        for a, b in sorted((x["lo"], x["hi"]) for x in iv):
            if a > at:
                left.append({"at": at + 1, "n": a - at})
            at = max(at, b)
        if at < size:
            left.append({"at": at + 1, "n": int(size) - at})
        out.append(left)
    return pd.Series(out, dtype=object)


def _passage(w: Column, lo: Column, hi: Column, width: int) -> Column:
    return F.array_join(F.slice(w, lo + 1, hi - lo + width), " ")


def _passages(d: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, item, n_words, passage): the words of each item's windows, lo to hi, from d (doc_id, th, t)."""
    mine = items.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set("item").alias("items"))
    e = d.join(mine.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).withColumn("w", words(F.col("t")))
    e = e.select("doc_id", "th", "w", F.explode("items").alias("item"))
    return e.select("doc_id", "th", "item", F.size("w").alias("n_words"), _passage(F.col("w"), F.col("item.lo"), F.col("item.hi"), width).alias("passage"))


def _found(passages: DataFrame, width: int) -> DataFrame:
    """(anchor, p1, p2, lo, hi): stretches of each passage whose windows occur twice or more.  passages: anchor, p1, p2, n, passage, meet;
    passages that can share a window have equal `meet`."""
    words_ = F.size(F.split("passage", " ")) * F.least(F.col("n"), F.lit(2))
    total = passages.agg(F.sum(words_)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    rows = passages.select("anchor", "p1", "p2", "n", "passage", F.pmod(F.xxhash64("meet"), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").applyInPandas(lambda pdf: _search(pdf, width), "anchor long, p1 long, p2 long, lo long, hi long")


def repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, th, stretches array<struct<at, n>>): for documents with repeated windows, the stretches of words (from 1) that none covers; th is the hash of the text.

    Equal windows have equal anchors at equal places, so all windows that can be equal meet under one anchor.  Windows
    of a document that share an anchor are one passage; anchors seen once drop out.  Equal passages are counted into
    one row before the shuffle.  The distinct passages of an anchor go to one shard with an FM-index, and are streamed
    through it.  Those of a very common anchor go window by window, dealt by the whole window, so that no shard or task
    has to hold the anchor.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("t")).withColumn("th", F.xxhash64("t"))
    flat = d.select("doc_id", "th", F.transform(words(F.col("t")), lambda x: F.xxhash64(x)).alias("h"))
    runs = saved(flat.mapInArrow(lambda it: _anchors(it, width), "anchor long, doc_id long, th long, run long"))
    # counts are summed before the shuffle
    often = saved(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    common = often.where(F.col("n") > max(HOT, total // PARTS)).select("anchor")  # PARTS rows at most
    rare = runs.join(F.broadcast(common), "anchor", "left_anti").join(often.select("anchor").hint("merge"), "anchor")
    met = saved(rare.union(runs.join(F.broadcast(common), "anchor")))
    forget(runs)
    release(spark)
    runs_of = met.select("doc_id", "th", F.struct("anchor", F.shiftright("run", 32).cast("int").alias("lo"), F.col("run").bitwiseAND(0xFFFFFFFF).cast("int").alias("hi")).alias("item"))
    occ = _passages(d, runs_of, width).withColumn("p1", F.xxhash64("passage")).withColumn("p2", F.xxhash64(F.lit(1), "passage"))
    occ = saved(occ.select("item.anchor", "doc_id", "th", "item.lo", "item.hi", "n_words", "p1", "p2"))
    forget(met)
    release(spark)
    reg = saved(occ.groupBy("anchor", "p1", "p2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("rep")))
    calm = reg.join(F.broadcast(common), "anchor", "left_anti")
    many = calm.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("anchor", F.lit(True).alias("wide"))
    both = calm.join(many, "anchor", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    both = both.unionByName(reg.join(F.broadcast(common), "anchor").withColumn("wide", F.lit(True)))
    want = both.select("rep.doc_id", "rep.th", F.struct("rep.lo", "rep.hi", "anchor", "p1", "p2", "n", "wide").alias("item"))
    open_ = saved(_passages(d, want, width).select("item.anchor", "item.p1", "item.p2", "item.n", "item.wide", "passage"))
    release(spark)
    found = _found(open_.where("not wide").withColumn("meet", F.col("anchor")), width)
    # very common anchors: a window is a passage of its own
    ws = open_.where("wide").withColumn("w", F.split("passage", " "))
    ws = ws.select("anchor", "p1", "p2", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("at"))
    ws = ws.withColumn("one", F.array_join(F.slice("w", F.col("at") + 1, width), " "))
    ws = saved(ws.select("anchor", "p1", "p2", "n", "at", "one", F.xxhash64("one").alias("q1"), F.xxhash64(F.lit(1), "one").alias("q2")))
    wins = ws.groupBy("q1", "q2").agg(F.sum("n").alias("n"), F.first("one").alias("passage"))
    wins = wins.select(F.col("q1").alias("anchor"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n", "passage", F.col("q1").alias("meet"))
    again = _found(wins, width).select(F.col("p1").alias("_q1"), F.col("p2").alias("_q2"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    mine = (F.col("q1") == F.col("_q1")) & (F.col("q2") == F.col("_q2")) & (F.pmod("p1", F.lit(SALTS)) == F.col("_salt"))
    at = F.col("at").cast("long")
    iv = saved(found.union(ws.drop("one").join(again, mine).select("anchor", "p1", "p2", at.alias("lo"), (at + width).alias("hi"))))
    release(spark)
    out = occ.select("anchor", "p1", "p2", "doc_id", "th", "n_words", F.col("lo").alias("base")).join(iv, ["anchor", "p1", "p2"])
    covered = F.struct((F.col("base") + F.col("lo")).cast("int").alias("lo"), (F.col("base") + F.col("hi")).cast("int").alias("hi"))
    out = out.groupBy("doc_id", "th", "n_words").agg(F.collect_set(covered).alias("covered"))
    out = saved(out.select("doc_id", "th", _stretches("n_words", "covered").alias("stretches")))
    for x in (often, occ, reg, open_, ws, iv):
        forget(x)
    release(spark)
    return out


def substring_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs with text cut down, and n_words, n_removed.

    Every word covered by a window of `width` words that occurs elsewhere too, in the same document or another, goes; all
    occurrences go.  Windows are judged on the input.  Texts that lose nothing stay as they are; of others the words left
    are joined by one space.  Null texts have no words; repeated rows are documents of their own, so they lose
    every window; documents with fewer words than a window lose none.  Other columns pass unchanged.
    """
    r = repeats(docs, width).select(F.col("doc_id").alias("__tidemark_d"), F.col("th").alias("__tidemark_t"), F.col("stretches").alias("__tidemark_stretches"))
    d = docs.withColumn("__tidemark_body", body())
    d = d.join(r.hint("shuffle_hash"), d["doc_id"].cast("long").eqNullSafe(r["__tidemark_d"]) & (F.xxhash64("__tidemark_body") == F.col("__tidemark_t")), "left")
    d = d.withColumn("__tidemark_w", words(F.col("__tidemark_body")))  # after the shuffle
    d = d.withColumn("__tidemark_n", F.size("__tidemark_w").cast("long")).withColumn("__tidemark_kept", F.when(F.col("__tidemark_stretches").isNotNull(), F.flatten(F.transform("__tidemark_stretches", lambda s: F.slice(F.col("__tidemark_w"), s["at"], s["n"])))))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    text = F.when(F.col("__tidemark_stretches").isNull(), F.col("__tidemark_body")).otherwise(F.array_join("__tidemark_kept", " ")).alias("text")
    return d.select(*[text if c == "text" else docs[c] for c in names], F.col("__tidemark_n").alias("n_words"), F.when(F.col("__tidemark_stretches").isNull(), 0).otherwise(F.col("__tidemark_n") - F.size("__tidemark_kept")).cast("long").alias("n_removed"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage.  Columns as those of docs."""
    return restored(docs, substring_dedup, "n_words", "n_removed")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    one_space = F.btrim(F.regexp_replace("text", SPLIT, " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.when(F.col("n_removed") == 0, one_space).otherwise(F.col("text")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 33, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + 34), ' '))) AS c FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h WHERE c > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
