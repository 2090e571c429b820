"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, body, drop, exists, forget, hash128, load, restored, saved, scratch, strip, without


def key(line: Column) -> Column:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(strip(line))


class LineRuns:
    """Levelled sorted runs of line keys: (h1, h2, n_docs, last_doc), each key in one run only, and the hits of later batches.

    add() merge-joins a batch with the runs.  Keys that no run holds (the anti-join's rows) become a run of level 0;
    those that one holds go to the hits.  A level with `fanout` runs is compacted into one run of the next, so each row
    is rewritten about log_fanout(batches) times.  repeated() needs no sum over the runs: a key without hits was met
    in one batch only, so its run row is complete.
    """

    KEY, SCHEMA = ["h1", "h2"], "h1 long, h2 long, n_docs long, last_doc long"

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.root = spark, fanout, scratch(spark)
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = f"{self.root}/{kind}-{self.made}"
        self.made += 1
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def runs(self) -> DataFrame:
        """Every key met so far, once, as its first batch had it."""
        return self._read([p for level in self.levels for p in level])

    def _push(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._read(old).repartitionByRange(*self.KEY).sortWithinPartitions(*self.KEY)
            self._push(self._write(merged, f"level{level + 1}"), level + 1)
            for path in old:
                drop(self.spark, path)

    def add(self, keys: DataFrame) -> None:
        """keys: doc_id, h1, h2.  Rows that repeat a document's key count once; a document's rows belong to one batch."""
        once = keys.groupBy(*self.KEY, "doc_id").agg(F.lit(1).alias("one"))
        batch = once.groupBy(*self.KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.made:
            self._push(self._write(batch.sortWithinPartitions(*self.KEY), "level0"), 0)
            return
        held = self.runs().select(*self.KEY, F.lit(1).alias("held"))
        both = batch.join(held.hint("merge"), self.KEY, "left").withColumn("held", F.coalesce("held", F.lit(0)))
        path = f"{self.root}/batch-{self.made}"
        self.made += 1
        # one merge join parts the batch; its rows come out sorted by key
        both.write.option("compression", "zstd").partitionBy("held").parquet(path)
        if exists(self.spark, f"{path}/held=0"):
            self._push(f"{path}/held=0", 0)
        if exists(self.spark, f"{path}/held=1"):
            self.hits.append(f"{path}/held=1")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows whose key no run holds."""
        return keys.join(self.runs().select(*self.KEY).hint("merge"), self.KEY, "left_anti")

    def repeated(self, least: int) -> DataFrame:
        """(h1, h2, last_doc) of keys met in `least` documents or more."""
        last, runs = F.max("last_doc").alias("last_doc"), self.runs()
        hits = self._read(self.hits).groupBy(*self.KEY).agg(F.sum("n_docs").alias("more"), last.alias("later"))
        all_ = runs.join(hits.hint("merge"), self.KEY, "left").where(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= least)
        return all_.select(*self.KEY, F.greatest("last_doc", "later").alias("last_doc"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """docs with text cut down, and n_lines, n_dropped.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines except those
    of the largest doc_id that holds them.  The table is dealt into batches by document, and each batch goes through
    the runs.  A null or empty text is one empty line; the text comes back empty.  Documents are told by doc_id:
    rows that share one count once, and share its fate; null is one doc_id, below all others.  Other columns pass unchanged.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    lines = F.split(body(), "\n")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("th"), F.transform(lines, key).alias("ks"))
    d = d.select("doc_id", "th", F.posexplode("ks").alias("pos", "k")).where(F.char_length("k") >= min_chars)
    d = d.select("doc_id", "th", "pos", hash128(F.col("k")).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    keys = saved(d.select("doc_id", "th", "pos", "h.h1", "h.h2", "batch"), "batch")
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
    repeated = saved(runs.repeated(min_docs))
    drop(spark, runs.root)
    gone = keys.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("__tidemark_id"), F.col("th").alias("__tidemark_th"))
    gone = saved(gone.agg(F.collect_set("pos").alias("__tidemark_gone")))  # at most the lines of one text
    forget(keys), forget(repeated)
    mine = docs["doc_id"].cast("long").eqNullSafe(gone["__tidemark_id"]) & (F.xxhash64(body()) == gone["__tidemark_th"])
    out = docs.join(gone.hint("shuffle_hash"), mine, "left").withColumn("__tidemark_lines", lines)
    text = F.when(F.col("__tidemark_gone").isNull(), body()).otherwise(without("__tidemark_lines", "__tidemark_gone")).alias("text")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_dropped = F.when(F.col("__tidemark_gone").isNull(), 0).otherwise(F.size("__tidemark_gone"))
    return out.select(*[text if c == "text" else docs[c] for c in names], F.size("__tidemark_lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def cut_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage.  Columns as those of docs."""
    return restored(docs, line_dedup, "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.last_doc) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
