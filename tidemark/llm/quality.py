"""Quality rules: per-text figures and cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, body, hash128, load, saved, strip, without, words

#: A line is boilerplate of its host if more than MAX_DOCS of the host's documents hold it, however many the host has.
MAX_DOCS = 50
#: A document is depleted if boilerplate lines hold more than this share of its words.
MAX_LOST = 0.7


def _figures(docs: DataFrame, host: str) -> DataFrame:
    """A row per document: counts of its text, and the key and words of each of its lines."""
    d = docs.select("doc_id", F.col(host).cast("string").alias("host"), body().alias("t"))
    d = d.withColumn("w", words(F.col("t"))).withColumn("all", F.split("t", "\n"))
    d = d.withColumn("ls", F.filter("all", lambda x: strip(x) != "")).withColumn("n_words", F.size("w").cast("long"))
    grams = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = d.withColumn("g", F.slice(grams, F.lit(1), F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))))
    d = d.withColumn("gs", F.sort_array("g"))
    d = d.withColumn("some", F.exists(F.transform("gs", lambda x, i: x.eqNullSafe(F.get("gs", i + 1))), lambda x: x))
    # windows by hash and place: those with an equal neighbour occur twice
    d = d.withColumn("at", F.when(F.col("some"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twin = lambda x, i: x["h"].eqNullSafe(F.get("at", i + 1)["h"]) | ((i > 0) & x["h"].eqNullSafe(F.get("at", F.greatest(i - 1, F.lit(0)))["h"]))
    covered = F.flatten(F.transform(F.filter("at", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    line = lambda x: F.struct(hash128(ascii_lower(strip(x))).alias("k"), F.size(words(x)).alias("n"))
    return d.select(
        "doc_id", "host", hash128(F.col("t")).alias("th"), "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("some"), F.size(F.array_distinct(covered))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("all", line).alias("lines"),
    )


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, min_words: int = 50, max_repeat: int = 50) -> tuple[DataFrame, DataFrame]:
    """Verdicts, and the lines that go.

    A verdict row per document: doc_id, th (hash of its text), host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lost (words in boilerplate lines), kept.  Lines that go: doc_id, th, host, and the places
    (from 0) of its boilerplate lines.  Lines are compared without white space at both ends and with A-Z lower-cased; a
    line's documents are counted by distinct doc_id (null is one) for each host, copies included.  Three-word windows and lines
    are compared by hashes of 64 and 128 bits.  A null or empty text has no words and fails the base rules; null hosts
    form one host; repeated rows each get a verdict; an empty table gives none.
    """
    f = saved(_figures(docs, host))
    line = f.select("doc_id", "host", "th", F.posexplode("lines").alias("pos", "l")).where("l.n > 0")
    line = line.select("doc_id", "host", "th", "pos", "l.n", "l.k")
    seen = line.groupBy("host", "k", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "k").agg(F.count("*").alias("n_docs"))
    over = saved(seen.where(F.col("n_docs") > max_docs).select(F.col("host").alias("_h"), F.col("k").alias("_k")))
    bad = line.join(over, F.col("host").eqNullSafe(F.col("_h")) & (F.col("k") == F.col("_k"))).select("doc_id", "th", "host", "pos", "n").distinct()
    bad = bad.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("host").alias("_h"))
    gone = saved(bad.agg(F.sum("n").alias("n"), F.collect_set("pos").alias("places")))  # at most the lines of one text
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & F.col("host").eqNullSafe(F.col("_h"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = f.select("doc_id", "th", "host", *counts).join(gone.drop("places").hint("shuffle_hash"), same, "left")
    out = out.select("doc_id", "th", "host", *counts, base.alias("base_failed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_lost"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") <= max_lost * F.col("n_words")))
    return out, gone.select(F.col("_d").alias("doc_id"), F.col("_t").alias("th"), F.col("_h").alias("host"), "places")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = quality_rules(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rejected documents go, boilerplate lines of the others go.  Columns as those of docs."""
    v, gone = quality_rules(docs)
    names = ("doc_id", "th", "host")
    ok = v.where("kept").select(*[F.col(c).alias(f"__tidemark_{c}") for c in names]).distinct()
    bad = gone.select(*[F.col(c).alias(f"__tidemark_bad_{c}") for c in names], F.col("places").alias("__tidemark_gone"))
    same = [F.col(f"__tidemark_{c}").eqNullSafe(F.col(f"__tidemark_bad_{c}")) for c in names]
    ok = ok.join(bad, same, "left").drop(*[f"__tidemark_bad_{c}" for c in names])
    d = docs.withColumn("__tidemark_t", body()).withColumn("__tidemark_h", hash128(F.col("__tidemark_t")))
    mine = d["doc_id"].eqNullSafe(ok["__tidemark_doc_id"]) & (d["__tidemark_h"] == ok["__tidemark_th"])
    d = d.join(ok.hint("shuffle_hash"), mine & d["source"].cast("string").eqNullSafe(ok["__tidemark_host"]))
    d = d.withColumn("__tidemark_ls", F.split("__tidemark_t", "\n"))
    clean = F.when(F.col("__tidemark_gone").isNull(), F.col("__tidemark_t")).otherwise(without("__tidemark_ls", "__tidemark_gone"))
    d = d.withColumn("__tidemark_c", clean)
    return d.select(*[{"text": F.col("__tidemark_c"), "n_chars": F.char_length("__tidemark_c").cast("long")}.get(c, docs[c]).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
             translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, host, unnest(ls) AS x FROM d)),
o AS (SELECT host, k FROM l GROUP BY host, k HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
x AS (SELECT doc_id, sum(n) AS n FROM l SEMI JOIN o USING (host, k) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_lost
      FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= {MAX_LOST} * n_words AS kept,
       CAST(n_lost AS BIGINT) AS n_lost FROM f
"""
