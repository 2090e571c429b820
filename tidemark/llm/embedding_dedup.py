"""Embedding near-dedup: robust-pruned flat graphs on overlapping shards, and range-expanding search."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import forget, load, saved
from tidemark.llm.components import components

#: Vectors in a shard, about; shards a vector is in; vectors that centroids are fitted on for each label, at most;
#: centroids of all labels, at most (shards grow beyond that).
SHARD, OVERLAP, FIT, CENTROIDS = 600, 4, 20_000, 16_384
#: Neighbours kept by robust pruning, candidates it takes, its slack, and the width of the search.
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 48, 1.2, 32
#: Links to any nodes that each node has besides, so that dense groups can be reached.
FAR = 10
#: Queries of the recall audit.
AUDIT = 200


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1.  A power of two keeps squares of very large and very small values in range, and digits as they are."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(lists) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in lists])


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


def robust_prune(sim: np.ndarray, near: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row of candidates (nearest first), those kept: a candidate goes if a kept one is alpha times nearer to it than the node is.

    All nodes are pruned in lock-step; -1 fills free places."""
    n, c = near.shape
    out, alive = np.full((n, degree), -1, np.int64), near >= 0
    dist = np.where(alive, 1 - sim, np.inf)
    vec = x[np.maximum(near, 0)]
    for k in range(degree):
        pick = np.where(alive, dist, np.inf).argmin(1)
        some = alive[np.arange(n), pick]
        if not some.any():
            break
        out[some, k] = near[some, pick[some]]
        to = 1 - np.einsum("ncd,nd->nc", vec, vec[np.arange(n), pick])
        alive &= ~((alpha * to <= dist) & some[:, None])
        alive[np.arange(n), pick] = False
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency of one shard: pruned candidates, links back while places are free, and FAR links to any nodes."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int64)
    near, sims = np.empty((n, k), np.int64), np.empty((n, k))
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, 1)
        o = np.argsort(-v, 1, kind="stable")
        near[i : i + 512], sims[i : i + 512] = np.take_along_axis(top, o, 1), np.take_along_axis(v, o, 1)
    out = np.concatenate([robust_prune(sims[i : i + 2048], near[i : i + 2048], x) for i in range(0, n, 2048)])
    # groups larger than CANDIDATES would be islands
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    return np.concatenate([_with_back(out, DEGREE + DEGREE // 2), np.where(far == np.arange(n)[:, None], -1, far)], 1)


def _with_back(out: np.ndarray, width: int) -> np.ndarray:
    n = len(out)
    a, b = np.repeat(np.arange(n), out.shape[1]), out.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    mine = np.isin(pairs, a * n + b)
    src, dst = pairs // n, pairs % n
    order = np.lexsort((dst, ~mine, src))
    src, dst = src[order], dst[order]
    first = np.r_[0, np.flatnonzero(src[1:] != src[:-1]) + 1]
    place = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)]))
    adj = np.full((n, width), -1, np.int64)
    ok = place < width
    adj[src[ok], place[ok]] = dst[ok]
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, medoids: np.ndarray, least: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs with similarity of at least `least`, the query itself excepted.

    Greedy beam search from the medoids, all queries of a block in lock-step; then everything in range is expanded
    until nothing new in range turns up."""
    n = len(x)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        m = len(q)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        sim = np.full((m, beam), -np.inf)
        done = np.zeros((m, beam), bool)
        start = np.broadcast_to(medoids[:beam], (m, min(beam, len(medoids))))
        ids[:, : start.shape[1]] = start
        sim[:, : start.shape[1]] = np.einsum("mkd,md->mk", x[start], x[q])
        seen[np.arange(m)[:, None], start] = True
        hits = [(np.repeat(np.arange(m), start.shape[1]), start.reshape(-1), sim[:, : start.shape[1]].reshape(-1))]
        while True:
            open_ = np.where(done | (ids < 0), -np.inf, sim)
            pick = open_.argmax(1)
            go = np.flatnonzero(open_[np.arange(m), pick] > -np.inf)
            if not len(go):
                break
            done[go, pick[go]] = True
            nb = adj[ids[go, pick[go]]]
            fresh = (nb >= 0) & ~seen[go[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            node, row = nb[r, c], go[r]
            seen[row, node] = True
            s = np.einsum("nd,nd->n", x[node], x[q[row]])
            hits.append((row, node, s))
            new_s, new_i = np.full(nb.shape, -np.inf), np.full(nb.shape, -1, np.int64)
            new_s[r, c], new_i[r, c] = s, node
            all_s, all_i = np.concatenate([sim[go], new_s], 1), np.concatenate([ids[go], new_i], 1)
            all_d = np.concatenate([done[go], np.zeros(nb.shape, bool)], 1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sim[go], ids[go], done[go] = (np.take_along_axis(v, best, 1) for v in (all_s, all_i, all_d))
        row, node, s = (np.concatenate(v) for v in zip(*hits, strict=True))
        inside = s >= least
        row, node = row[inside], node[inside]
        found = [(row, node)]
        while len(row):  # all in range are expanded, however many there are
            nxt_r, nxt_n = [], []
            for k in range(0, len(row), 8192):
                nb = adj[node[k : k + 8192]]
                r = np.repeat(row[k : k + 8192], nb.shape[1])
                nb = nb.reshape(-1)
                ok = nb >= 0
                r, nb = r[ok], nb[ok]
                ok = ~seen[r, nb]
                code = np.unique(r[ok] * n + nb[ok])
                r, nb = code // n, code % n
                seen[r, nb] = True
                near = np.einsum("nd,nd->n", x[nb], x[q[r]]) >= least
                nxt_r.append(r[near])
                nxt_n.append(nb[near])
            row, node = np.concatenate(nxt_r), np.concatenate(nxt_n)
            found.append((row, node))
        row, node = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        other = node != q[row]
        yield q[row[other]], node[other]


def _valid(c: Column) -> Column:
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return c.isNotNull() & fine & F.exists(c, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, least: float = 0.93, audit: int = AUDIT) -> DataFrame:
    """(vec_id, label, rep, n_links, component_id): vectors whose cosine, in double precision, is `least` or more are linked.

    Only vectors of one label and length are compared.  Vectors that are null, empty, zero or hold null, NaN or infinite
    values, and rows with a null label, link with nothing and form components of their own.  Repeated rows and equal vectors are linked with
    each other.  Equal vectors are searched once.  Centroids are fitted for each label on a sample of FIT vectors at most
    (the least by hash); every vector is in the shards of its OVERLAP
    nearest centroids, and of all within 1.6 times the linking angle.  Each shard builds a
    robust-pruned graph, a vector's adjacency lists are united, and each vector searches the united graph around its nearest
    shard.  `audit` vectors are held against all rows in blocks; a recall below 0.9 warns.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("ok", F.col("label").isNotNull() & F.coalesce(_valid(F.col("e")), F.lit(False)))
    v = v.withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(1), "e").alias("h2"), F.col("label").alias("l"), F.size("e").alias("d"))))
    v = saved(v)
    one = v.where("ok").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    one = saved(one.select(F.monotonically_increasing_id().alias("node"), F.concat_ws("/", "h.l", "h.d").alias("part"), "rep", "copies", "e"))
    sizes = {r["part"]: r["n"] for r in one.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(CENTROIDS).collect()}
    total = max(1, sum(sizes.values()))
    unit = SHARD // 2 if total < SHARD * CENTROIDS // 2 else 2 * total // CENTROIDS
    want = {p: max(1, n // unit) for p, n in sizes.items()}
    split = {p: k for p, k in want.items() if k > 1}
    centers: dict[str, np.ndarray] = {}
    if split:
        share = F.create_map(*[x for p in split for x in (F.lit(p), F.lit(min(1.0, 1.2 * FIT / sizes[p])))])
        pick = one.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < F.try_element_at(share, F.col("part")) * 1_000_000).groupBy("part").applyInPandas(lambda pdf: _fit(pdf, split), "part string, c int, e array<double>")
        for r in sorted(pick.collect(), key=lambda r: (r["part"], r["c"])):  # CENTROIDS rows at most
            centers.setdefault(r["part"], []).append(r["e"])
        centers = {p: np.array(c) for p, c in centers.items()}
    shared = spark.sparkContext.broadcast(centers)
    # two steps of the linking angle, less what a centroid among the linked vectors saves: dense groups with several centroids meet whole
    close = np.cos(1.6 * np.arccos(least))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, part, vec = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object), b.column(2).to_pylist()
            ns, shards, primary, es = [], [], [], []
            for p in set(part):
                i = np.flatnonzero(part == p)
                c = shared.value.get(p)
                if c is None:
                    mine, first = np.ones((len(i), 1), bool), np.zeros(len(i), np.int64)
                else:
                    s = _unit(_matrix([vec[k] for k in i])) @ c.T
                    near = np.argsort(-s, 1, kind="stable")[:, :OVERLAP]
                    mine, first = s >= close, near[:, 0]
                    np.put_along_axis(mine, near, True, 1)
                r, k = np.nonzero(mine)
                ns += node[i[r]].tolist()
                shards += [f"{p}/{x}" for x in k]
                primary += (first[r] == k).tolist()
                es += [vec[x] for x in i[r]]
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), pa.array(shards, pa.string()), pa.array(primary, pa.bool_()), pa.array(es, pa.list_(pa.float64()))], ["node", "shard", "main", "e"])

    dealt = saved(one.select("node", "part", "e").mapInArrow(deal, "node long, shard string, main boolean, e array<double>"))
    lists = dealt.groupBy("shard").applyInPandas(_build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = saved(united)
    rows = dealt.join(united.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("shard", "node", "main", "e", "near")
    found = rows.groupBy("shard").applyInPandas(lambda pdf: _search(pdf, least), "a long, b long")
    # a link found from either side counts for both
    pairs = saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    weight = one.select(F.col("node").alias("_n"), "copies")
    ends = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).join(weight, F.col("b") == F.col("_n")).groupBy(F.col("a").alias("_a")).agg(F.sum("copies").alias("others"))
    if audit:
        _audit(one, pairs, least, audit)
    comp = components(pairs)
    named = one.select("node", "rep", "copies").join(comp.withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left").withColumn("c", F.coalesce("component", "node"))
    named = saved(named.select("node", "rep", "copies", "c"))
    least_id = named.groupBy(F.col("c").alias("_c")).agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, F.col("c") == F.col("_c")).join(ends, F.col("node") == F.col("_a"), "left").select("rep", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "node")
    named = named.join(one.select(F.col("node").alias("_o"), F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(1), "e").alias("h2"), "part"), F.col("node") == F.col("_o"))
    out = v.join(named, (v["h.h1"] == named["h1"]) & (v["h.h2"] == named["h2"]) & (F.concat_ws("/", "h.l", "h.d") == F.col("part")), "left")
    forget(dealt), forget(united)
    return out.select("vec_id", "label", "rep", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _fit(pdf: pd.DataFrame, want: dict[str, int]) -> pd.DataFrame:
    part = pdf["part"].iloc[0]
    x = _unit(_matrix(pdf.sort_values("rep")["e"][:FIT]))
    c = fit_centroids(x, min(want[part], len(x)))
    return pd.DataFrame({"part": part, "c": range(len(c)), "e": list(c)})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    node = pdf["node"].to_numpy()
    adj = build_graph(_unit(_matrix(pdf["e"])))
    return pd.DataFrame({"node": node, "near": [node[a[a >= 0]] for a in adj]})


def _search(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The shard's own vectors search the united lists; entries outside the shard are left out."""
    node, x = pdf["node"].to_numpy(), _unit(_matrix(pdf["e"]))
    order = np.argsort(node)
    size = np.array([0 if v is None else len(v) for v in pdf["near"]])
    adj = np.full((len(node), max(1, int(size.max(initial=0)))), -1, np.int64)
    for i, v in enumerate(pdf["near"]):
        if v is not None and len(v):
            k = np.minimum(np.searchsorted(node[order], v), len(node) - 1)
            adj[i, : len(v)] = np.where(node[order][k] == v, order[k], -1)
    medoid = np.argsort(-(x @ x.mean(0)), kind="stable")[:1]
    spread = np.random.default_rng(5).choice(len(x), min(23, len(x)), replace=False)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q, n in range_search(x, adj, np.flatnonzero(pdf["main"].to_numpy()), np.unique(np.r_[medoid, spread]), least):
        a.append(node[q])
        b.append(node[n])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _audit(one: DataFrame, pairs: DataFrame, least: float, queries: int) -> float:
    """Recall of the links of a few vectors, each held against all rows in blocks."""
    q = one.orderBy(F.xxhash64("rep", F.lit(11))).limit(queries).select("node", "part", "e").collect()
    if not q:
        return 1.0
    shared = one.sparkSession.sparkContext.broadcast([(r["node"], r["part"], np.array(r["e"])) for r in q])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, part = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object)
            vec, a, z = b.column(2).to_pylist(), [], []
            for p in set(part):
                i = np.flatnonzero(part == p)
                mine = [x for x in shared.value if x[1] == p]
                if mine:
                    s = _unit(_matrix([vec[k] for k in i])) @ _unit(np.stack([x[2] for x in mine])).T
                    r, c = np.nonzero(s >= least)
                    a += [mine[k][0] for k in c]
                    z += node[i[r]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    true = one.select("node", "part", "e").mapInArrow(scan, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    r = true.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("n"), F.sum("hit").alias("hit")).first()
    recall = (r["hit"] or 0) / r["n"] if r["n"] else 1.0
    if recall < 0.9:
        warnings.warn(f"embedding near-dedup: the audit found {recall:.3f} of the links", stacklevel=2)
    return recall


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
