"""Nulls in any column, repeated rows, very long texts and clashing column names: defined results of each operator and stage."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, embedding_dedup, line_dedup, packing, quality, sharding, simhash, substring_dedup, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of the operators' outputs and inner steps, as columns of the input.
CLASH = ("n_words", "n_removed", "n_lines", "n_dropped", "kept", "h1", "h2", "k", "t", "w", "fp", "component_id", "node", "shard", "slot", "anchor", "_d", "_t", "th", "bin_id", "score", "host", "lines", "batch", "bad", "uid", "h", "e", "n")
LINE = "a line that stands in many documents\n"
ROWS = [
    (None, None, None, None, None), (None, "", "en", None, 0), (1, None, "en", "web", None), (2, "  \n\t ", "en", "web", 5),
    (3, LINE + " ".join(f"w{i}" for i in range(60)), None, None, 9), (3, LINE + " ".join(f"w{i}" for i in range(60)), None, None, 9),
    (4, LINE + " ".join(f"v{i}" for i in range(70)), "en", "web", 9), (None, LINE + " ".join(f"u{i}" for i in range(80)), "en", None, 9),
    (5, "long " + " ".join(f"x{i % 9000}y{i % 7}" for i in range(40_000)), "en", "web", 9), (6, "z" * 300_000, "en", "web", 9),
]


@pytest.fixture(scope="module")
def table(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        d = d.withColumn(c, F.lit("own"))
    return d


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


WANT = Counter(r[0] for r in ROWS)


def test_one_row_each(table):
    """A row per input row, null ids and repeats included."""
    for out in (quality.quality_rules(table)[0], line_dedup.line_dedup(table), simhash.simhash_dedup(table), substring_dedup.substring_dedup(table), sharding.balanced_shards(table), bpe.round_trip(table)):
        assert ids(out) == WANT, out.columns


def test_lines_by_null_id(table):
    out = line_dedup.line_dedup(table).collect()
    assert Counter((r["doc_id"], r["n_dropped"]) for r in out if (r["text"] or "").endswith(("w59", "v69", "u79"))) == {(3, 1): 2, (4, 0): 1, (None, 1): 1}
    assert all(r["h1"] == "own" and r["k"] == "own" for r in out)


def test_substrings_of_repeated_rows(table):
    out = substring_dedup.substring_dedup(table).collect()
    by = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in out}
    assert by[3, 67] == 67 and by[4, 77] == 0 and by[None, 87] == 0 and by[6, 1] == 0
    assert all(r["anchor"] == "own" for r in out)


def test_anchor_runs_in_parts(monkeypatch):
    """A text longer than a part has the same windows and anchors as in one part."""
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    spread = lambda runs: {(int(s), int(a)) for a, lo, hi in zip(*runs[1:], strict=True) for s in range(lo, hi + 1)}
    whole = substring_dedup.anchor_runs(h, np.array([0, 5000]), 35)
    monkeypatch.setattr(substring_dedup, "PART", 1024)
    parts = substring_dedup.anchor_runs(h, np.array([0, 5000]), 35)
    assert spread(whole) == spread(parts) and len(spread(parts)) == 5000 - 34
    assert sum(int((hi - lo + 1)) for lo, hi in zip(*parts[2:], strict=True)) == 5000 - 34


@pytest.mark.parametrize("hot,parts", [(4, 10_000), (4, 2), (2_000, 10_000)])
def test_hot_anchors(spark, monkeypatch, hot, parts):
    """Passages of one anchor beyond HOT or a share of 1 / PARTS: equal windows are found, windows that differ in the middle stay."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "PARTS", parts)
    head, tail = [f"h{i}" for i in range(16)], [f"t{i}" for i in range(16)]
    texts = [" ".join([f"p{k}", *head, f"a{k % 9}", "b", "c", *tail, f"q{k}"]) for k in range(12)] + ["solo " * 3]
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in substring_dedup.substring_dedup(d).collect():
        w = split[r["doc_id"]]
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r["n_removed"] == len(gone), r["doc_id"]


def test_packing_of_null_ids(table):
    got = Counter()
    for r in packing.pack(table).collect():
        got[r["doc_id"]] += r["length"]
    want = Counter()
    for i, t, *_ in ROWS:
        want[i] += len(WORD.findall(t or "")) + 1
    assert got == want


def test_toxicity_of_nulls(spark, table):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (1, 0), (4, 0), (6, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(table, toxicity.train(table, labels))
    assert ids(out) == WANT and all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.toxicity(table.limit(0), toxicity.train(table.limit(0), labels)).count() == 0


def test_embeddings_repeated(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.1], 1, "x"), (3, [0.0, 1.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], None, "x"), (5, [float("inf"), 0.0], 1, "x"), (6, [1e-200, 0.0], 1, "x"), (7, [1e200, 1e199], 1, "x"), (8, [1.0, 0.0, 0.0], 1, "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").withColumn("component_id", F.lit("own"))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(d).collect())
    assert got == Counter({(1, 5, 1): 2, (2, 5, 1): 1, (3, 0, 3): 1, (None, 5, 1): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 5, 1): 1, (7, 5, 1): 1, (8, 0, 8): 1})


def test_warc_of_nulls(spark, tmp_path):
    rows = [(None, None, None, 1), (None, "u", "same", 1), (1, None, "same", 1), (2, "u", "same", 1), (2, "u", "same", 1)]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string, payload int").withColumn("sha", F.lit("own")), f"file://{tmp_path}/w")
    got = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in spark.read.format("warc").option("path", f"file://{tmp_path}/w").load().collect())
    assert got == Counter({("urn:page:2", "response", None): 2, ("urn:page:1", "revisit", "urn:page:2"): 1, ("urn:page:null", "revisit", "urn:page:2"): 1, ("urn:page:null", "response", None): 1})


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert spark.read.format("warc").option("path", f"file://{tmp_path}/w").load().count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, table, name, stage):
    """Stages keep the columns, run on nulls and on no rows, and keep rows that share an id but not their text apart."""
    empty = stage(spark, table.limit(0), "")
    assert empty.count() == 0
    out = stage(spark, table, "")
    if name != "best_fit_packing":
        assert out.columns == table.columns == empty.columns
        assert dict(out.dtypes) == dict(table.dtypes)
        rows = out.collect()
        assert all(r["h1"] == "own" for r in rows)
    if name == "simhash_near_dedup":
        # one of the empty texts, one of the repeated rows, and every other text
        assert Counter(r["text"] for r in rows if WORD.search(r["text"] or "")) == Counter({t: 1 for _, t, *_ in ROWS if WORD.search(t or "")})
        assert sum(not WORD.search(r["text"] or "") for r in rows) == 1
