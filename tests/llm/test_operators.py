"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as P
from tidemark.llm import bpe, embedding_dedup, line_dedup, packing, quality, sharding, simhash, substring_dedup, toxicity, warc
from tidemark.llm.common import release, saved
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words long, shard int, _t string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, f"s{i % 3}", 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    passage = prose(rng, 60)
    out = base + [base[0]] * 5 + [base[1] + " " + passage, passage + " x", prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 5)]
    near = prose(rng, 3000).split(" ")
    for k in range(12):
        out.append(" ".join([*near[:k], "zz", *near[k + 1 :]]))
    line = "A common LINE of text, long enough"
    out += [f"{line}\nown {k}\n {line.lower()} \n" for k in range(4)]
    return [*out, None, "", "  \n\t ", "one", "a b", "ab " * 4000]


def test_substrings(spark, texts):
    width = 35
    seen = Counter()
    split = [WORD.findall(t or "") for t in texts]
    for w in split:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] += 1
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(split):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        assert got[k]["n_removed"] == len(gone) and got[k]["n_words"] == len(w) and got[k]["shard"] == 2
        assert WORD.findall(got[k]["text"]) == [x for j, x in enumerate(w) if j not in gone]


def test_lines(spark, texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held[key(x)].add(k)
    for r in line_dedup.line_dedup(docs(spark, texts), batches=5, fanout=2).collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != r["doc_id"])]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_runs(spark):
    """Each batch is merge-anti-joined with the runs: a key stands in one run, later batches are hits."""
    runs = line_dedup.LineRuns(spark, fanout=2)
    rows = lambda *k: spark.createDataFrame([(d, h, 0) for d, h in k], "doc_id long, h1 long, h2 long")
    for d in range(5):
        runs.add(rows((d, d % 2), (d, 7), (d, 7), (d, 100 + d)))
    held = [r["h1"] for r in runs.runs().collect()]
    assert sorted(held) == [0, 1, 7, 100, 101, 102, 103, 104] and len(runs.hits) == 4
    assert {(r["h1"], r["last_doc"]) for r in runs.repeated(3).collect()} == {(0, 4), (7, 4)}
    assert {(r["h1"], r["last_doc"]) for r in runs.repeated(2).collect()} == {(0, 4), (7, 4), (1, 3)}
    assert [r["h1"] for r in runs.unseen(rows((9, 1), (9, 8))).collect()] == [8]


def fingerprint(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if g and 2 * sum(x >> b & 1 for x in h) > len(g))


def closed(n, linked, ids):
    par = list(range(n))

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                par[b] = a
    return {ids[i]: ids[top(i)] for i in range(n)}


def test_simhash(spark, texts):
    fp = [fingerprint(t) for t in texts]
    want = closed(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2, list(range(len(fp))))
    got = {r["doc_id"]: r for r in simhash.simhash_dedup(docs(spark, texts)).collect()}
    assert {k: r["fp"] & (2**64 - 1) for k, r in got.items()} == dict(enumerate(fp))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert len(set(want.values())) < len(set(fp))


def test_keep_first_near_copies(spark):
    """The pipeline stage takes all texts with a 5-word Jaccard similarity of 0.8 or more, by brute force, as near copies."""
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        w = prose(rng, rng.randint(60, 200)).split(" ")
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = "zz" + prose(rng, 1)
            texts.append(" ".join(v))
    hub = prose(rng, 300).split(" ")
    texts += [" ".join([*hub[:k], f"new{k}", *hub[k + 1 :]]) for k in range(5, 295)] + ["one two", "One  two", "", " "]
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = closed(len(texts), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]), list(range(len(texts))))
    fps = [fingerprint(t) for t in texts]
    assert any(want[i] == want[j] and (fps[i] ^ fps[j]).bit_count() > 2 for i in range(100) for j in range(i))
    assert {r["doc_id"] for r in simhash.keep_first(docs(spark, texts)).collect()} == set(want.values())


def exchanges(df, column):
    """Numbers of the shuffles in the plan that carry a column, or buffers of first() that may hold it, and the whole plan; lower numbers run first."""
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [int(k) for k, x in re.findall(r"^\((\d+)\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M) if re.search(rf"\b({column}|first)#", x)], plan


def test_keep_first_shuffles_texts_once(spark):
    """Texts move once, though kept rows are looked up and repeated rows go; null ids stay apart from 0."""
    rng = random.Random(8)
    a, b, c = (prose(rng, 80) for _ in range(3))
    out = simhash.keep_first(docs(spark, [a, a, a, b, b, c, c, None, ""], [4, 4, 9, None, None, 0, None, 7, 5]))
    assert len(exchanges(out, "text")[0]) == 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter({(4, a): 1, (None, b): 1, (0, c): 1, (5, ""): 1})


@pytest.mark.parametrize("bits", [2, 18])
def test_unwanted_texts_go_ahead_of_the_shuffle(spark, monkeypatch, bits):
    """Also where no table of nodes may be sent out, and where texts share bits."""
    monkeypatch.setattr(simhash, "WORDS", bits)
    rng = random.Random(9)
    nodes = [rng.getrandbits(64) - 2**63 for _ in range(3000)] + [-1, 0, 2**63 - 1, -(2**63)]
    texts = spark.createDataFrame([(x, f"t{i}") for i, x in enumerate(nodes)], "node long, t string")
    want = sorted(nodes[k] for k in range(0, len(nodes), 7))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash._wanted(texts, spark.createDataFrame([(x,) for x in want], "node long"))
        moved, plan = exchanges(out, "t")
        first = int(re.search(r"^\((\d+)\) BroadcastHashJoin", plan, re.M)[1])
        assert moved and min(moved) > first
        assert sorted(r["node"] for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_release_frees_the_last_shuffle(spark):
    """Files of the last job's shuffle go, not only those of jobs before it."""
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for d in folders for x in Path(d).rglob("shuffle_*")}
    before = files()
    saved(spark.range(1000).repartition(3))
    assert files() - before
    release(spark)
    end = time.time() + 5
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before


def test_near_links_in_groups_of_variants(spark, monkeypatch):
    """Variants of one text, most of them less than 0.8 alike, and copies of some variants: components by brute force, and few pairs compared."""
    rng = random.Random(33)
    base, texts = prose(rng, 150).split(" "), []
    for k in range(120):
        v = [w for w in base if rng.random() > 0.02]
        for _ in range(rng.randint(0, 12)):
            v[rng.randrange(len(v))] = f"e{k}" + prose(rng, 1)
        texts.append(" ".join(v if k % 3 else v[: rng.randint(100, len(v))]))
    for k in range(20):
        v = texts[rng.randrange(120)].split(" ")
        v[rng.randrange(len(v))] = f"f{k}"
        texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(t.lower()) for t in texts)]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = closed(len(texts), alike, list(range(len(texts))))
    counts, plain = [], simhash._unconnected

    def counted(delta):
        out = plain(delta)
        counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_unconnected", counted)
    assert {r["doc_id"] for r in simhash.keep_first(docs(spark, texts)).collect()} == set(want.values())
    assert 20 < len(set(want.values())) < 120
    assert counts[0] < 140 * 139 / 2 / 4


def test_near_copies_meet_by_wildcard_variants(spark):
    """The stage's SimHash: bits differ as the angle says, and all texts that share a variant, are near by check bits and of different components meet."""
    rng, bits, segments = np.random.default_rng(3), 12, 19
    common, own = rng.integers(-(2**63), 2**63, 800), rng.integers(-(2**63), 2**63, (2, 100))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[*common, *x] for x in own], pa.list_(pa.int64()))], ["node", "s"])  # 0.8 alike
    (out,) = simhash._wide(iter([batch]), bits, segments)
    f, g = (np.bitwise_count(np.bitwise_xor(*out.column(i).to_numpy().view(np.uint64))) for i in (1, 2))
    v = np.stack([np.frombuffer(x.as_py(), np.int32) for x in out.column(3)])
    assert abs((f + g + np.bitwise_count(v[0] ^ v[1]).sum()) / (128 + bits * segments) - simhash.NEAR_BITS) < 0.06
    assert any(np.bitwise_count(v[0] ^ v[1]) < 2)

    rows, base = [], rng.integers(0, 2**bits, (40, 3))
    for node in range(400):  # more than PAIRWISE around the first base
        one = base[0 if node < 150 else node % 40] ^ (1 << rng.integers(0, bits, 3)) * rng.integers(0, 2, 3)
        check = [int.from_bytes(rng.bytes(8), "little", signed=True) if rng.random() < 0.3 else 7 for _ in "fg"]
        rows.append((node, node if node % 3 else 0, *check, one.astype(np.int32)))
    d = spark.createDataFrame([(*r[:4], r[4].tobytes()) for r in rows], "node long, c long, f long, g long, v binary")
    halves = d.mapInArrow(lambda it: simhash._halves(it, bits, 0, 3), "key long, node long, c long, f long, g long").repartition(4, F.shiftright("key", bits // 2))
    for size in ("7", "10000"):  # groups cut by batches and whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        met = halves.sortWithinPartitions("key").mapInArrow(lambda it: simhash._meets(it, bits), "key long, node long, m long").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        buckets = defaultdict(set)
        for r in met:
            buckets[r["key"]].add(r["node"])
        assert all(len(buckets[r["key"]]) == r["m"] for r in met)
        got = {(a, b) for x in buckets.values() for a in x for b in x if a < b}
        near = lambda a, b: sum(((a[i] ^ b[i]) & (2**64 - 1)).bit_count() for i in (2, 3)) <= simhash.CHECK
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and near(a, b) and (np.bitwise_count(a[4] ^ b[4]) < 2).any()}
        assert want and want <= got


def test_rarity_gathers_a_byte_for_each_cell(spark, monkeypatch):
    """Counts that reach the driver are small whatever they count, and shingles of few deltas still come first."""
    frame, plain, gathered = type(spark.range(0)), type(spark.range(0)).toArrow, []

    def seen(df):
        gathered.append(plain(df))
        return gathered[-1]

    monkeypatch.setattr(frame, "toArrow", seen)
    rows = [(5, i, 900, 900, i, [1, *([2] if i < 280 else []), *([3] if i < 3 else []), 1000 + i]) for i in range(400)]
    rows += [(6, 1000, 900, 900, 0, list(range(10_000, 12_000)))]
    out = simhash._by_rarity(spark.createDataFrame(rows, "lead long, node long, n int, n_lead int, c long, delta array<long>"))
    rest = {r["node"]: r["rest"] for r in out.collect()}
    assert sum(x.nbytes for x in gathered) < 1.1 * 2**simhash.CELLS
    assert rest[0][-3:] == [3, 2, 1] and rest[279][-2:] == [2, 1] and rest[399][-1] == 1


def test_members_of_small_leaders_need_no_row_for_a_shingle(spark, monkeypatch):
    """However many deltas there are, none of a small leader reaches the shared cells, and the pairs are those of brute force."""
    rng, rows = random.Random(8), []
    for lead in range(300):
        own = [rng.sample(range(900), rng.randint(20, 60)) for _ in range(2)]
        for i in range(8):
            delta = {*own[i % 2], *rng.sample(range(1000, 1400), rng.randint(0, 40))}
            rows.append((lead, 10 * lead + i, rng.randint(150, 200), 180, 10 * lead + i // 2, sorted(delta)))
    monkeypatch.setattr(simhash, "_by_rarity", lambda d: pytest.fail(f"{d.count()} deltas in the cells"))
    d = spark.createDataFrame(rows, "lead long, node long, n int, n_lead int, c long, delta array<long>")
    got = simhash._unconnected(d.repartition(3)).collect()
    alike = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 : i + 8] if a[0] == b[0] and a[4] != b[4] and 9 * len({*a[5]} ^ {*b[5]}) <= a[2] + b[2]}
    assert alike >= {(r["a"], r["b"]) for r in got} and len(alike) > 100
    nodes = [r[1] for r in rows]
    top = lambda pairs: components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in top(alike)} == {(r["node"], r["component"]) for r in top({(r["a"], r["b"]) for r in got})} and len(nodes) == 2400


def test_one_owner_and_one_row_for_each_leader(spark):
    """Texts that meet in many variants are a row for each leader, and texts of one owner don't meet again."""
    k, node, w = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50), np.tile([1, 9, 1, 1], 50)
    assert simhash._leads(k, node, w).to_pylist() == [{"lead": 1, "node": x, "w": 9} for x in (0, 2, 3)]
    led, owner = simhash._owned(spark.createDataFrame([(1, 2, 9), (2, 3, 5), (2, 4, 5), (1, 4, 9), (7, 8, 3)], "lead long, node long, w long"))
    assert {tuple(r) for r in led.collect()} == {(1, 2), (2, 3), (2, 4), (1, 4), (1, 3), (7, 8)}
    assert {r["node"]: r["o"] for r in owner.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    names = ["key", "node", "c", "f", "g", "o", "w"]
    for n in (6, 200):
        rows = [np.zeros(n, np.int64), *[np.arange(n)] * 2, *[np.zeros(n, np.int64)] * 2, np.arange(n) // 2, np.arange(n)]
        for owners, want in ((rows[5], n - 1), (rows[3], 0)):
            x = pa.RecordBatch.from_arrays([pa.array(y) for y in (*rows[:5], owners, rows[6])], names)
            met = [r for b in simhash._meets(iter([x]), 12, simhash._leads) for r in b.to_pylist()]
            assert len(met) == want and {r["lead"] for r in met} <= {n - 1}


def test_simhash_large_bucket(spark):
    """Far more fingerprints in a bucket than are compared pair by pair, and all around 0."""
    rng = random.Random(5)
    fps = {0}
    for _ in range(400):
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in found.collect())
    group = {r["node"]: r["component"] for r in components(found).collect()}
    want = closed(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2, signed)
    assert Counter(Counter(want.values()).values()) == Counter(Counter(group.get(x, x) for x in signed).values())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    have = {frozenset(p) for p in pairs if None not in p}
    want = closed(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in have, nodes)
    assert got == want


def test_packing(spark, texts):
    caps = (64, 128, 512)
    rows = packing.pack(docs(spark, texts), capacities=caps).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {k: len(WORD.findall(t or "")) + 1 for k, t in enumerate(texts)}
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["bin_pos"]):
            assert r["bin_pos"] == at
            at += r["length"]
        assert at == b[0]["filled"] and b[0]["capacity"] == min(c for c in caps if c >= at)
    assert sorted(bins) == list(range(len(bins)))


def test_packing_is_best_fit(spark):
    """The histogram plan packs what best-fit decreasing packs piece by piece."""
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    plan = packing.Plan(Counter(sizes), (100,))
    free = []
    for s in sizes:
        fit = [x for x in free if x >= s]
        if fit:
            free.remove(min(fit))
        free.append((min(fit) if fit else 100) - s)
    assert plan.bins == len(free)


def test_bpe(spark, texts):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = [*texts, "日本語テキスト 𝔘😀 ́", "x" * 3000 + "aé" * 1500, "it's 123 !!  \n\n end  ", "<|endoftext|>"]
    h = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.round_trip(docs(spark, own)).collect():
        t = own[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), h(",".join(map(str, ids)).encode()), h(t.encode()))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark, own))).collect()}
    assert back == {k: t or "" for k, t in enumerate(own)}


def test_utf8_stream():
    data = ("aé日😀" * 7).encode() + b"\xff\xe6\x97"
    for step in (1, 2, 3, 5):
        m = bpe.Utf8Stream()
        assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.close() == data.decode("utf-8", "replace")


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, "http://b/\r\n5", "same"), (3, None, None), (4, "http://a/4", ""), (6, "http://a/6", "é" * 100_000), (7, "u", "one")]
    warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    read = lambda **o: spark.read.format("warc").option("path", f"file://{tmp_path}/w").options(**o).load()
    got = {r["record_id"]: r for r in read(verify="true").collect()}
    assert len(got) == 7
    for i, _, html in pages:
        r, raw = got[f"urn:page:{i}"], (html or "").encode()
        last = max(x[0] for x in pages if (x[2] or "") == (html or ""))
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.digest(raw)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == i else ("revisit", f"urn:page:{last}"))
        assert (r["payload"] is None) if last != i else bytes(r["payload"]) == raw
    some = read(payload="false").where("record_type = 'revisit' and target_uri like 'http://a/%'")
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:1", "urn:page:2"]


def test_warc_skips_payloads(spark, tmp_path):
    """Bytes unpacked: headers alone where payloads aren't wanted or the header fails a pushed predicate."""
    from pyspark.sql.datasource import EqualTo

    rng = random.Random(3)
    pages = [(i, f"http://a/{i}", rng.randbytes(40_000).hex()) for i in range(12)] + [(100 + i, "http://b/", "twin") for i in range(3)]
    warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")

    def unpacked(filters=(), **options):
        reader = warc.WarcReader({"path": f"file://{tmp_path}/w"} | options)
        assert not list(reader.pushFilters(list(filters)))
        rows = [x for part in reader.partitions() for x in reader.read(part)]
        return reader.decoded, rows

    whole, rows = unpacked()
    assert whole > 12 * 80_000 and len(rows) == 15
    revisits, rows = unpacked([EqualTo(("record_type",), "revisit")])
    assert revisits < whole / 15 and sorted(r[0] for r in rows) == ["urn:page:100", "urn:page:101"]
    heads, rows = unpacked(payload="false")
    assert heads < whole / 15 and sorted(r[5] for r in rows) == [4] * 3 + [80_000] * 12
    one, rows = unpacked([EqualTo(("target_uri",), "http://a/4")])
    assert one < whole / 6 and len(rows[0][6]) == 80_000


def cut_share(own, rows):
    """Share of the pairs of equal texts whose ends are in different shards."""
    where = defaultdict(Counter)
    for r in rows:
        where[own[r["doc_id"]] or ""][r["shard"]] += 1
    pairs = sum(n * (n - 1) for n in (sum(c.values()) for c in where.values()))
    return 1 - sum(n * (n - 1) for c in where.values() for n in c.values()) / max(1, pairs)


def test_sharding(spark, texts):
    rng = random.Random(11)
    own = texts + texts[:20] + ["hot"] * 150 + [prose(rng, 12) for _ in range(400)]
    rows = sharding.balanced_shards(docs(spark, own)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(own)))
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        assert r["size"] == len((own[r["doc_id"]] or "").encode()) + 1
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) == 16
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    where = defaultdict(set)
    for r in rows:
        where[own[r["doc_id"]] or ""].add(r["shard"])
    assert sum(len(where[t]) == 1 for t in texts[1:20]) >= 17 and len(where["hot"]) < 12


def test_sharding_full(spark):
    """All rows linked, so that no shard has room: groups still come together, by exchange."""
    own = [f"text {k}" for k in range(400) for _ in range(10)]
    rows = sharding.balanced_shards(docs(spark, own)).collect()
    assert set(Counter(r["shard"] for r in rows).values()) == {250}
    assert cut_share(own, rows) < 0.1


def test_sharding_ties(spark):
    """Groups spread evenly, two of them larger than a shard, and quotas that don't divide."""
    own = ["a"] * 37 + ["b"] * 41 + [f"t{k}" for k in range(16) for _ in range(2)] + [None] * 5
    rows = sharding.balanced_shards(docs(spark, own), shards=5).collect()
    n = Counter(r["shard"] for r in rows)
    assert sum(n.values()) == len(own) and max(n.values()) - min(n.values()) <= 1
    # a group of 41 fills one shard of 23 and a part of another at best: 0.45 to 0.5 of its pairs are cut
    assert cut_share(own, rows) < 0.62


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    for k in range(120):
        x[rng.integers(1500)] = x[7] + rng.normal(size=16) * 0.1
    x[20:30] = x[19]
    label = rng.integers(0, 2, 1500)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(1500)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, x[7].tolist(), None), (2004, [None] * 16, 0), (2005, [], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(2000, 2006))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = ((u @ u.T >= 0.93) & (label[:, None] == label[None])).sum(1) - 1
    have = np.array([got[i]["n_links"] for i in range(1500)])
    assert (have <= links).all() and have.sum() >= 0.95 * links.sum()


def test_block_max_index():
    """The k nearest by cosine are those of brute force, in order, though only a part of the postings is read."""
    rng = random.Random(6)
    sets = []
    for _ in range(1500):
        topic = rng.randrange(60)
        c = Counter({topic: 3} | dict.fromkeys(rng.sample(range(60, 300), rng.randint(0, 12)), 1))
        sets.append((np.array(sorted(c)), np.array([c[t] for t in sorted(c)], float)))
    sets[7] = (np.empty(0, np.int64), np.empty(0))
    weights = np.r_[np.full(60, 6.0), np.linspace(0.5, 2, 240)]
    index = toxicity.BlockMaxIndex([(i, i % 2, *x) for i, x in enumerate(sets)], weights)
    whole = np.zeros((1500, 300))
    at = {d: i for i, d in enumerate(index.docs.tolist())}
    for d, x in enumerate(sets):
        t, w = index.vector(*x)
        whole[at[d], t] = w
    touched = 0
    for x in sets[:200]:
        rows, sim = index.nearest(*x, k=10)
        t, w = index.vector(*x)
        full = whole[:, t] @ w if len(t) else np.zeros(1500)
        best = np.lexsort((np.arange(1500), -full.round(12)))[:10]
        assert np.allclose(full[best][: len(sim)], sim) and np.allclose(full[rows], sim) and (len(rows) == 10 or not full[best][len(rows) :].any())
        touched += sum(int(index.start[index.entry[k + 1]] - index.start[index.entry[k]]) for k in t)
    assert 0 < index.read < touched / 2


def test_common_terms_are_read_as_rows():
    """Postings of terms of many examples aren't read one by one; ties still go to the smaller row."""
    rng = np.random.default_rng(4)
    sets = [(np.unique(np.r_[np.flatnonzero(rng.random(20) < 0.5), rng.integers(20, 3000, 15)]), None) for _ in range(700)]
    sets = [(t, rng.integers(1, 4, len(t)).astype(float)) for t, _ in sets]
    sets += sets[:100]  # equal examples
    index = toxicity.BlockMaxIndex([(i, i % 2, *x) for i, x in enumerate(sets)], rng.random(3000) + 0.1, 128)
    assert (index.dense[:20] >= 0).all() and (index.dense[20:] < 0).all() and index.rows.shape == (20, 896)
    whole, at = np.zeros((800, 3000)), {d: i for i, d in enumerate(index.docs.tolist())}
    for d, x in enumerate(sets):
        t, w = index.vector(*x)
        whole[at[d], t] = w
    touched, (start, entry) = 0, (index.start, index.entry)
    for x, common in zip(sets[:150], index.common(sets[:150]), strict=True):
        t, w = index.vector(*x)
        touched += int((start[entry[t + 1]] - start[entry[t]]).sum())
        full = (whole[:, t] @ w).round(12)
        rows, sim = index.nearest(*x, 10, common)
        assert [y.tolist() for y in index.nearest(*x, 10)] == [rows.tolist(), sim.tolist()]
        assert rows.tolist() == np.lexsort((np.arange(800), -full))[:10].tolist() and np.allclose(sim, full[rows])
    assert index.read / 2 < touched / 4
    assert {"rows", "dense", "place"}.isdisjoint(index.__getstate__())  # never sent


def test_toxicity_votes(spark):
    """Evidence and scores follow from brute-force cosines over all the examples' words."""
    rng = random.Random(18)
    texts = [prose(rng, 30) + (" mean vile" if i % 3 == 0 else " kind") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    vocabulary, index = list(model.number.value), model.index.value
    assert set(vocabulary) == {w for t in texts[:60] for w in re.findall(r"\w+", t.lower())} and sorted(index.docs.tolist()) == list(range(60))
    df = Counter(w for t in texts for w in set(t.lower().split()))
    share = Counter((w, i % 3 == 0) for i, t in enumerate(texts[:60]) for w in set(t.lower().split()))
    weight = {}
    for w in vocabulary:
        a, b = share[w, True], share[w, False]
        weight[w] = (np.log(91 / (1 + df[w])) + 1) * np.sqrt(60 * (a * (40 - b) - b * (20 - a)) ** 2 / max(1, (a + b) * (60 - a - b) * 800))

    def vector(t):
        v = {w: (1 + np.log(n)) * weight[w] for w, n in Counter(t.lower().split()).items() if w in weight}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()} if size else {}

    known = [vector(t) for t in texts[:60]]
    for r in toxicity.toxicity(docs(spark, texts), model).collect():
        v = vector(texts[r["doc_id"]])
        cos = np.array([sum(x * k.get(w, 0) for w, x in v.items()) for k in known])
        top = np.argsort(-cos, kind="stable")[: toxicity.NEAREST]
        top = top[cos[top] > 0]
        base = 20 / 60
        vote = (cos[top] @ (top % 3 == 0) + toxicity.PRIOR * base) / (cos[top].sum() + toxicity.PRIOR)
        assert abs(r["score"] - model.calibration.score(vote)) < 1e-6 and np.allclose(cos[list(r["evidence"])], cos[top[:3]])


def test_toxicity(spark):
    rng = random.Random(8)
    texts = [prose(rng, 40) + (" vile words here" if i % 4 == 0 else "") for i in range(300)] + [None, "", "vile " * 3000]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, toxicity.train(d, labels)).collect()}
    assert len(got) == 303 and all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200, 300)) and got[300] == got[301] < 0.3 and got[302] > 0.7
    none = toxicity.toxicity(d, toxicity.train(d, labels.limit(0)))
    assert {0 <= r["score"] <= 1 for r in none.collect()} == {True}


def test_quality(spark):
    """Lines by distinct documents of the host, copies included, against brute force; depleted documents go."""
    rng = random.Random(9)
    boiler = "This very line stands on all the pages of the host"
    texts = [prose(rng, 80) + "\n" + boiler for _ in range(60)] + ["\n".join([boiler] * 7), "a b c " * 40, None, "", "x y z w " * 30 + prose(rng, 200)]
    d = docs(spark, texts)
    v, gone = quality.quality_rules(d.withColumn("source", F.lit(None).cast("string")), max_docs=60)
    got = {r["doc_id"]: r for r in v.collect()}
    places = {r["doc_id"]: sorted(r["places"]) for r in gone.collect()}
    assert places == {i: [1] for i in range(60)} | {60: list(range(7))} and all(got[i]["kept"] and got[i]["n_lost"] == 11 for i in range(60))
    assert not got[60]["kept"] and got[61]["base_failed"] and got[61]["n_repeat_words"] == 120 and got[62]["n_words"] == 0
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i]["n_repeat_words"] == len({j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)})
    assert not any(r["n_lost"] for r in quality.quality_rules(d, max_docs=21)[0].collect())  # 21 documents of a host at most
    copies = docs(spark, [texts[0]] * 8 + texts[1:6]).withColumn("source", F.lit("one"))
    assert {r["doc_id"] for r in quality.quality_rules(copies, max_docs=7)[0].where("not kept").collect()} == set(range(8))
    same = [x for x in quality.keep_good(d.withColumn("source", F.lit("one"))).collect()]
    assert {r["doc_id"] for r in same} == set(range(60)) | {64} and all(boiler not in r["text"] for r in same)


def test_empty_tables(spark):
    d = docs(spark, [])
    for out in (quality.quality_rules(d)[0], line_dedup.line_dedup(d), simhash.simhash_dedup(d), substring_dedup.substring_dedup(d), packing.pack(d), sharding.balanced_shards(d), bpe.round_trip(d), embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns and out.count() <= d.count()
        d = out
