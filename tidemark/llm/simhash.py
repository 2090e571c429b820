"""SimHash near-dedup with one-wildcard segment variants."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, body, forget, load, packed, release, saved, words
from tidemark.llm.components import components

#: Buckets up to this many fingerprints are compared pair by pair; larger ones go through the exact clique variants.
PAIRWISE = 48
#: The pipeline stage links texts whose sets of NEAR_WORDS-word shingles have a Jaccard similarity of 4/5 or more.  At 4/5 a share
#: NEAR_BITS of the bits of their SimHashes differs, as the cosine is 8/9.  Segments are so many that one has a wildcard variant in
#: common with a probability of 1 - MISS; then CHECK_BITS further bits must agree but for CHECK, which 1e-5 of such pairs exceed.
NEAR_WORDS, NEAR_BITS, MISS = 5, math.acos(8 / 9) / math.pi, 3e-5
CHECK_BITS, CHECK = 128, 38
#: The segments of the first round, which connects most near copies; later ones only look at texts not connected yet.
EARLY, AT_ONCE = 8, 24
#: The segments that tell which texts share most buckets; the members of a leader that are compared in one task at most, and their shingles.
WEIGH, TOGETHER, IN_ALL = 4, 512, 2_000_000
#: Bits of the number of words, of 64 bits each, that tell which texts may be wanted.
WORDS = 18
#: Bits of the cells that count shingles of differing members, and of the pieces in which the counts travel.
CELLS, CHUNK = 22, 16


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
        at = lists.offsets.to_numpy()
        out = np.zeros((len(b), 8), np.uint8)
        for i in range(len(b)):
            n, total = int(at[i + 1] - at[i]), np.zeros(64, np.int64)
            for k in range(int(at[i]), int(at[i + 1]), 65536):
                total += np.add.reduce(np.unpackbits(values[k : min(k + 65536, int(at[i + 1]))], axis=1, bitorder="little"), axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * total > n, bitorder="little")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.reshape(-1).view(np.int64))], ["doc_id", "th", "fp"])


def _shingles(w: str, size: int) -> Column:
    """Hashes of the runs of `size` words; no words have none, fewer than `size` words are one."""
    gram = F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, size)])))
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.slice(gram, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, th, fp long): a row per document; th is the hash of its text.  Shingles are hashed in the JVM; bit majorities are taken per Arrow batch.

    Null, empty and blank texts have fingerprint 0; texts of fewer than `size` words are one shingle.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("th"), words(ascii_lower(body())).alias("w"))
    return d.select("doc_id", "th", _shingles("w", size).alias("h")).mapInArrow(_majority, "doc_id long, th long, fp long")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 one-wildcard variants of each fingerprint: (segment and wildcard, the other 31 bits of the segment)."""
    bit = np.arange(32, dtype=np.uint64)
    for b in batches:
        whole = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(whole), 4096):
            fp = whole[k : k + 4096]
            half = np.stack([fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)], 1)  # (n, 2)
            masked = half[:, :, None] & ~(np.uint64(1) << bit)  # (n, 2, 32)
            tag = (np.arange(2, dtype=np.uint64)[:, None] * np.uint64(32) + bit) << np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array((masked | tag).reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], ["sig", "fp"])


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sig: verified links of buckets up to PAIRWISE, and (sig, fp) of larger ones as heavy rows.

    Only the rows of a bucket that batches cut in two are carried on, PAIRWISE + 1 at most."""

    def out(a, b, heavy):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), heavy))], ["a", "b", "heavy"])

    sig, fp, big = np.empty(0, np.uint64), np.empty(0, np.uint64), None

    def work(sig, fp, big):
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[at, len(sig)])
        large = n > PAIRWISE
        if big is not None and len(at) and sig[0] == big:
            large[0] = True
        yes = np.repeat(large, n)
        if yes.any():
            yield out(fp[yes], sig[yes], True)
        for step in range(1, PAIRWISE):
            i = np.flatnonzero((sig[step:] == sig[:-step]) & ~yes[step:])
            if not len(i):
                break
            a, b = fp[i], fp[i + step]
            x = a ^ b
            near = np.bitwise_count(x) <= bits
            # a pair that shares several signatures is told by its first one only
            seg, wild = sig[i][near] >> np.uint64(37), (sig[i][near] >> np.uint64(32)) & np.uint64(31)
            x, a, b = x[near], a[near], b[near]
            low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
            d0, d1 = np.bitwise_count(low), np.bitwise_count(high)
            mine = np.where(seg == 0, low, high)
            first = np.where(mine == 0, np.uint64(0), np.bitwise_count(mine - (mine > 0).astype(np.uint64)).astype(np.uint64))
            ok = (wild == first) & ((seg == 0) | (d0 > 1)) & (np.where(seg == 0, d0, d1) <= 1)
            if ok.any():
                yield out(a[ok], b[ok], False)

    for batch in batches:
        s, f = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
        sig, fp = np.r_[sig, s], np.r_[fp, f]
        if not len(sig):
            continue
        cut = int(np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])[-1])  # the last bucket may go on
        if len(sig) - cut > PAIRWISE:  # it is large whatever follows
            yield from work(sig[:cut], fp[:cut], big)
            yield out(fp[cut:], sig[cut:], True)
            big, sig, fp = sig[-1], sig[:0], fp[:0]
            continue
        yield from work(sig[:cut], fp[:cut], big)
        if cut and big is not None and sig[cut] != big:
            big = None
        sig, fp = sig[cut:], fp[cut:]
    if len(sig):
        yield from work(sig, fp, big)


def _cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-wildcard variants of whole fingerprints: rows that share one differ in two bits at most, so each is a clique."""
    i, j = np.triu_indices(64, 1)
    mask = ~((np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64)))
    tag = (i * 64 + j).astype(np.int32)
    for b in batches:
        whole = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(whole), 64):
            fp = whole[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(tag, len(fp))), pa.array((fp[:, None] & mask).reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(mask)).view(np.int64))], ["tag", "rest", "fp"])


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most 2 bits; enough of them to connect every linked pair.

    Two segments of 32 bits: if two bits differ, one segment differs in one bit at most, so a pair shares a
    one-wildcard variant.  Buckets of up to PAIRWISE rows are verified pair by pair.  Of larger buckets, every row is
    keyed by its 2,016 two-wildcard variants; those that share one are all linked, so each links to the least only: exact,
    and no pairs of a large group are written.
    """
    if bits != 2:
        raise ValueError("the variants are made for two bits")
    sig = fps.select("fp").distinct().mapInArrow(_signatures, "sig long, fp long")
    met = sig.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(lambda it: _links(it, bits), "a long, b long, heavy boolean")
    met = saved(met)
    heavy = met.where("heavy").select("a").distinct()
    var = heavy.mapInArrow(_cliques, "tag int, rest long, fp long")
    least = var.groupBy("tag", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    # a bucket of two needs no second look; larger ones send each member to the least
    two = least.where("n = 2").select("a", F.col("z").alias("b"))
    many = var.join(least.where("n > 2").select("tag", "rest", "a").hint("merge"), ["tag", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return met.where("not heavy").select("a", "b").union(two).union(many)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp), and for each fp its component c, a fingerprint, with the least doc_id of its documents."""
    fp = saved(fingerprints(docs))
    group = components(links(fp))
    own = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = own.join(group, own["fp"] == group["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    return fp, saved(packed(named, fp.count()))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id long): a row per document; component_id is the smallest doc_id reachable by links.

    Equal fingerprints are linked.  Repeated rows are documents of their own with equal fingerprints; null doc_ids are
    kept and never give a component its name unless no other is there.  An empty table gives an empty table.
    """
    fp, named = _grouped(docs)
    root = named.groupBy("c").agg(F.min("least").alias("component_id"))
    top = named.join(root, "c").select("fp", "component_id")
    return fp.join(top, "fp").select("doc_id", "fp", "component_id")


def near_segments(texts: int) -> tuple[int, int]:
    """Bits of a segment, an even number, and segments of the stage's SimHash.

    Two texts that have nothing in common share a variant of a segment of b bits by chance, with b + 1 in 2**b: b grows with
    the logarithm of the number of texts, so that each meets as many strangers whatever the input."""
    bits = min(28, max(12, 2 * math.ceil((math.log2(max(texts, 2)) + 1.5) / 2)))
    same = (1 - NEAR_BITS) ** bits + bits * NEAR_BITS * (1 - NEAR_BITS) ** (bits - 1)
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def _wide(batches: Iterator[pa.RecordBatch], bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """From (node, shingle hashes): (node, f, g, v), the SimHash of CHECK_BITS + segments * bits bits; f and g are the check bits, v the segments."""
    rng = np.random.default_rng(6)
    width = -(-(CHECK_BITS + segments * bits) // 64)
    flip, one, two = (rng.integers(0, 2**64, width, np.uint64) for _ in range(3))
    one, two = one | np.uint64(1), two | np.uint64(1)
    power = 2.0 ** np.arange(bits)
    for b in batches:
        lists = b.column(1)
        values, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for k in range(0, len(b), 1024):
            o = at[k : k + 1025]
            up = np.zeros((len(o) - 1, 64 * width), bool)
            for i in range(len(up)):
                total = np.zeros(64 * width, np.int32)
                for j in range(int(o[i]), int(o[i + 1]), 255):  # sums of 255 fit a byte
                    h = (values[j : min(j + 255, int(o[i + 1])), None] ^ flip) * one
                    h = (h ^ (h >> np.uint64(32))) * two
                    h ^= h >> np.uint64(29)
                    total += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
                up[i] = 2 * total > o[i + 1] - o[i]
            check = np.packbits(up[:, :CHECK_BITS], axis=1, bitorder="little").view(np.int64)
            v = (up[:, CHECK_BITS : CHECK_BITS + segments * bits].reshape(-1, bits) @ power).astype(np.int32).reshape(len(up), segments)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1024), *(pa.array(np.ascontiguousarray(x)) for x in check.T), pa.array([x.tobytes() for x in v], pa.binary())], ["node", "f", "g", "v"])


def _halves(batches: Iterator[pa.RecordBatch], bits: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """From (node, c, f, g, v): two rows for each segment, (key, node, c, f, g), and what else the rows have.  A variant has its wildcard in
    one half of the segment, and that half is the end of the key: segment, which half, the other half, this half."""
    h = bits // 2
    for b in batches:
        own = [i for i in range(b.num_columns) if i != 4]
        if not len(b):
            continue
        v = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int32).reshape(len(b), -1)[:, first:last].astype(np.int64)
        s = np.arange(first, first + v.shape[1], dtype=np.int64) << (bits + 1)
        turned = (v & ((1 << h) - 1)) << h | v >> h
        key = np.stack([s | v, s | 1 << bits | turned], 2).reshape(len(b), -1)
        step = max(1, 65536 // max(1, key.shape[1]))
        for k in range(0, len(b), step):
            rows = [pa.array(np.repeat(b.column(i).to_numpy()[k : k + step], key.shape[1])) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + step].reshape(-1)), *rows], ["key", *(b.schema.names[i] for i in own)])


def _every(k: np.ndarray, node: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """(key, node, m) of texts that meet in variants k: m of them in each."""
    met, back, m = np.unique(k, return_inverse=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(met[back]), pa.array(node), pa.array(m[back])], ["key", "node", "m"])


def _weights(k: np.ndarray, node: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """(node, w): how many meet in the variants in which the text meets any."""
    _, back, m = np.unique(k, return_inverse=True, return_counts=True)
    own, at = np.unique(node, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, m[back]).astype(np.int64))], ["node", "w"])


def _leads(k: np.ndarray, node: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """(lead, node, w), each pair once: the text of each variant with the largest w leads, w is its own."""
    order = np.lexsort((node, w, k))
    k, node, w = k[order], node[order], w[order]
    last = np.flatnonzero(np.r_[k[1:] != k[:-1], True])
    top = np.repeat(last, np.diff(np.r_[-1, last]))
    rows = np.unique(np.stack([node[top], node, w[top]], 1)[node != node[top]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows.T], ["lead", "node", "w"])


def _meets(batches: Iterator[pa.RecordBatch], bits: int, tell=_every) -> Iterator[pa.RecordBatch]:
    """From rows of _halves() sorted by key: what `tell` makes of the texts of a variant that have one of another component c near them there.

    Near are those whose check bits differ in CHECK at most.  Rows may also have an owner o, and a weight w for `tell`: texts of one owner
    don't meet either.  In buckets of more than PAIRWISE texts, those that aren't of the commonest component or owner are compared with all;
    if they are very many, all count as near.  Texts of equal segments meet without a wildcard only."""
    h = bits // 2

    def near(f, g, i, j):
        return np.bitwise_count((f[i] ^ f[j]).view(np.uint64)) + np.bitwise_count((g[i] ^ g[j]).view(np.uint64)) <= CHECK

    def work(key, node, c, f, g, o=None, w=None):
        o, w, told = c if o is None else o, np.zeros(len(key), np.int64) if w is None else w, []
        for wild in range(-1, h):
            bit = np.int64(1 << wild if wild >= 0 else 0)
            rows = np.flatnonzero(key >> bits & 1 == 0) if wild < 0 else np.arange(len(key))
            k = key[rows] & ~bit
            order = np.argsort(k, kind="stable")
            k, rows = k[order], rows[order]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            n = np.repeat(np.diff(np.r_[at, len(k)]), np.diff(np.r_[at, len(k)]))
            k, rows, n = k[n > 1], rows[n > 1], n[n > 1]
            alive = np.zeros(len(k), bool)
            small = np.flatnonzero(n <= PAIRWISE)
            ks, rs = k[small], rows[small]
            for step in range(1, PAIRWISE):
                i = np.flatnonzero(ks[step:] == ks[:-step])
                if not len(i):
                    break
                a, b = rs[i], rs[i + step]
                ok = i[(c[a] != c[b]) & (o[a] != o[b]) & (key[a] ^ key[b] == bit) & near(f, g, a, b)]
                alive[small[ok]] = alive[small[ok + step]] = True
            large = np.flatnonzero(n > PAIRWISE)
            for own in np.split(large, np.flatnonzero(np.diff(k[large])) + 1) if len(large) else []:
                r = rows[own]
                if wild >= 0 and len(np.unique(key[r])) == 1:
                    continue
                few = r
                for kind in (c[r], o[r]):
                    _, which, count = np.unique(kind, return_inverse=True, return_counts=True)
                    few = min(few, np.flatnonzero(which != count.argmax()), key=len)
                if len(few) > 16 * PAIRWISE:
                    alive[own] = True
                    continue
                for x in few:
                    ok = (c[r] != c[r[x]]) & (o[r] != o[r[x]]) & (key[r] ^ key[r[x]] == bit) & near(f, g, r, r[x])
                    alive[own[ok]] = True
                    alive[own[x]] |= ok.any()
            if alive.any():
                told.append((k[alive] | (wild + 1) << 48, rows[alive]))
        if told:
            k, rows = (np.concatenate(x) for x in zip(*told, strict=True))
            yield tell(k, node[rows], w[rows])

    held: list[list[np.ndarray]] = []  # rows of the last group, which may go on
    for b in batches:
        if not len(b):
            continue
        x = [b.column(i).to_numpy() for i in range(b.num_columns)]
        part = x[0] >> h
        cut = int(np.searchsorted(part, part[-1]))
        if held and (cut or held[0][0][0] >> h != part[0]):
            yield from work(*map(np.concatenate, zip(*held, [y[:cut] for y in x], strict=True)))
            held = []
        elif cut:
            yield from work(*(y[:cut] for y in x))
        held.append([y[cut:] for y in x])
    if held:
        yield from work(*map(np.concatenate, zip(*held, strict=True)))


def _wanted(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of `texts` whose node is in `nodes`, which has each once.

    Most others go ahead of the shuffle, by a table of 2**WORDS words at most that is sent out however many nodes there are; the join decides."""
    word, bit = F.shiftrightunsigned("node", 64 - WORDS), F.expr("shiftleft(1L, cast(node & 63 as int))")
    some = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    likely = texts.withColumn("word", word).join(F.broadcast(some), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return likely.drop("word", "bits").join(nodes, "node")  # a semi-join would be moved ahead of the other one


def near_links(docs: DataFrame) -> DataFrame:
    """(a, b): hashes of texts with a Jaccard similarity of 4/5 or more; enough of them to connect every such pair of candidates.

    Candidates are found by SimHash: of two texts alike by 4/5 about 15 % of the bits differ, too many for 64 bits, so the
    fingerprints here are of near_segments() segments; texts that share a one-wildcard variant of one are a bucket.  Members of each
    bucket are verified against its leader first, so that copies of one text cost a row per member; then _unconnected() gives
    the pairs of members that may still be alike, and these are verified.  Blank texts count as one shingle.
    The first EARLY segments connect most near copies; for the others only texts of different components and owners meet (see _owned()).
    """

    def sets(d: DataFrame) -> DataFrame:
        d = d.select("node", words(ascii_lower(F.col("t"))).alias("w"))
        return d.select("node", F.array_distinct(F.when(F.size("w") == 0, F.array(F.lit(0).cast("long"))).otherwise(_shingles("w", NEAR_WORDS))).alias("s"))

    texts = docs.select(F.xxhash64(body()).alias("node"), body().alias("t"))
    bits, segments = near_segments(docs.count())
    wide = saved(sets(texts).mapInArrow(lambda it: _wide(it, bits, segments), "node long, f long, g long, v binary").distinct())

    def meets(named: DataFrame, first: int, last: int, tell, schema: str) -> DataFrame:
        """Rows of _meets() for some segments, written so that their shuffle can go."""
        rows = named.mapInArrow(lambda it: _halves(it, bits, first, last), "key long, node long, c long, f long, g long, o long, w long")
        rows = rows.repartition(F.shiftright("key", bits // 2)).sortWithinPartitions("key")
        out = saved(rows.mapInArrow(lambda it: _meets(it, bits, tell), schema))
        release(docs.sparkSession)
        return out

    def verified(led: DataFrame, found: DataFrame | None) -> DataFrame:
        """`found` and the links of the leaders' members, (lead, node)."""
        nodes = led.select("lead").union(led.select("node")).toDF("node").distinct()
        known = saved(sets(_wanted(texts, nodes).dropDuplicates(["node"])))
        release(docs.sparkSession)

        def with_sets(pairs: DataFrame) -> DataFrame:
            a, b = (known.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
            return pairs.join(a, "a").join(b, "b")

        pairs = with_sets(led.select(F.col("lead").alias("a"), F.col("node").alias("b")))
        differ = F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")).alias("delta")
        delta = saved(pairs.select(F.col("a").alias("lead"), F.col("b").alias("node"), F.size("sa").alias("n_lead"), F.size("sb").alias("n"), differ))
        release(docs.sparkSession)
        near = delta.where("9 * size(delta) <= n + n_lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        found = saved(near if found is None else found.union(near))
        rest = _unconnected(delta.join(components(found), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
        both = F.size(F.array_intersect("sa", "sb"))
        out = saved(found.union(with_sets(rest).where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")))
        for x in (known, delta, found):
            forget(x)
        return out

    node = F.col("node").alias
    # the text that shares most buckets with others leads: of a group of near copies that is what they were copied from
    some = meets(wide.select("node", node("c"), "f", "g", "v", node("o"), F.lit(0).cast("long").alias("w")), 0, WEIGH, _weights, "node long, w long")
    heavy = some.groupBy("node").agg(F.sum("w").alias("w"))
    wide_ = saved(wide.join(heavy, "node", "left").select("node", "f", "g", "v", F.coalesce("w", F.lit(0)).alias("w")))
    early = meets(wide_.select("node", node("c"), "f", "g", "v", node("o"), "w"), 0, EARLY, _leads, "lead long, node long, w long")
    led, owner = _owned(early)
    found = verified(led, None)
    named = wide_.join(components(found), "node", "left").join(owner, "node", "left")
    named = saved(named.select("node", F.coalesce("component", "node").alias("c"), "f", "g", "v", F.coalesce("o", "node").alias("o"), "w"))
    for x in (wide, some, wide_, early, led, owner):
        forget(x)
    late = [meets(named, k, min(k + AT_ONCE, segments), _leads, "lead long, node long, w long") for k in range(EARLY, segments, AT_ONCE)]
    led = saved(reduce(DataFrame.union, late).select("lead", "node").distinct())
    out = verified(led, found)
    for x in (named, found, led, *late):
        forget(x)
    release(docs.sparkSession)
    return out


def _owned(early: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lead, node) of `early` and more of them, each once; and (node, o): the owner of a text is the weightiest of its leaders, or itself if it leads.

    Where the leader of a text has a weightier leader, the text becomes a member of that one too, so that a large group has one owner.
    All members of a leader are compared with each other by verified(): texts of one owner need not meet again."""
    each = saved(early.union(early.select("lead", F.col("lead").alias("node"), "w")).distinct())
    best = F.max_by("lead", F.struct("w", "lead")).alias("lead")
    first = each.groupBy("node").agg(best, F.max("w").alias("w"))
    over = first.select(F.col("node").alias("lead"), F.col("lead").alias("top"), F.col("w").alias("w_top"))
    more = first.join(over, "lead").where("top <> lead").select(F.col("top").alias("lead"), "node", F.col("w_top").alias("w"))
    every = saved(each.union(more).distinct())
    owner = saved(every.groupBy("node").agg(best).select("node", F.col("lead").alias("o")))
    led = saved(every.where("lead <> node").select("lead", "node"))
    for x in (each, every):
        forget(x)
    return led, owner


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all shingles in the deltas of a batch: row, shingle, and the cell that counts the shingle under its leader."""
    n = np.diff(b.column("delta").offsets.to_numpy())
    row, shingle = np.repeat(np.arange(len(b)), n), b.column("delta").flatten().to_numpy(zero_copy_only=False)
    mixed = b.column("lead").to_numpy().view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) ^ shingle.view(np.uint64)
    return row, shingle, ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CELLS)).astype(np.int64)


def _by_rarity(d: DataFrame) -> DataFrame:
    """d with `rest`, the shingles of its delta that may be in others of the same leader, rare ones first.

    Shingles are counted in a table of 2**CELLS cells, which is all that is gathered and sent out, as a byte each: counts from 128 on
    by eighths of powers of two.  Shingles that share a cell count as more frequent than they are: the order stays one for all
    members, and a count of 1 stays certain."""

    def count(batches):
        total = np.zeros(1 << CELLS, np.int64)
        for b in batches:
            total += np.bincount(_cells(b)[2], minlength=len(total))
        yield pieces({i: x for i, x in enumerate(total.reshape(-1, 1 << CHUNK)) if x.any()})

    def add(batches):
        sums = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.int64)
        yield pieces({i: np.where(x < 128, x, np.minimum(255, 8 * np.log2(np.maximum(x, 1)) + 72)).astype(np.uint8) for i, x in sums.items()})

    def pieces(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["i", "k"])

    rows = packed(d.select("lead", "delta"), d.count(), 10_000)
    each = rows.mapInArrow(count, "i int, k binary")  # a row per piece and task, whatever the task holds
    met = each.repartition("i").mapInArrow(add, "i int, k binary").toArrow()
    total = np.zeros((1 << (CELLS - CHUNK), 1 << CHUNK), np.uint8)
    for i, x in zip(met.column("i").to_pylist(), met.column("k").to_pylist(), strict=True):
        total[i] = np.frombuffer(x, np.uint8)
    total = total.reshape(-1)
    shared = d.sparkSession.sparkContext.broadcast(total)

    def order(batches):
        for b in batches:
            row, shingle, cell = _cells(b)
            k = shared.value[cell]
            use = np.flatnonzero(k > 1)
            use = use[np.lexsort((shingle[use], k[use], row[use]))]
            offsets = np.r_[0, np.cumsum(np.bincount(row[use], minlength=len(b)))].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle[use]))
            yield pa.RecordBatch.from_arrays([*b.columns, rest], [*b.schema.names, "rest"])

    return d.mapInArrow(order, "lead long, node long, n int, n_lead int, c long, delta array<long>, rest array<long>")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lead, node, n, c, delta) sorted by lead: (a, b), so many pairs of members of a leader, of different components c and alike by 4/5
    or more, that they connect all such pairs.  Texts differ in the shingles that one of their deltas has and the other lacks."""

    def work(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, n, c = (rows.column(x).to_numpy() for x in ("node", "n", "c"))
        delta = rows.column("delta").combine_chunks()
        size = np.diff(delta.offsets.to_numpy())
        _, at, count = np.unique(delta.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        row, use = np.repeat(np.arange(len(node)), size), count[at] > 1
        place = (np.cumsum(count > 1) - 1)[at[use]]
        order = np.argsort(place, kind="stable")
        row, place = row[use][order], place[order]
        both = np.zeros((len(node), len(node)), np.float32)
        step = 4096
        for k in range(0, int(place[-1]) + 1 if len(place) else 0, step):
            i, j = np.searchsorted(place, (k, k + step))
            has = np.zeros((len(node), int(place[j - 1]) + 1 - k), np.float32)
            has[row[i:j], place[i:j] - k] = 1
            both += has @ has.T
        near = (9 * (size[:, None] + size - 2 * both.astype(np.int64)) <= n[:, None] + n) & (c[:, None] != c)
        a, b, left = [], [], np.ones(len(node), bool)
        for start in np.flatnonzero(near.any(1)):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near[x] & left)
                left[new] = False
                a, b, todo = a + [x] * len(new), b + new.tolist(), todo + new.tolist()
        a, b = node[np.array(a, np.int64)], node[np.array(b, np.int64)]
        return np.minimum(a, b), np.maximum(a, b)

    held: list[pa.RecordBatch] = []  # rows of the last leader, which may go on
    for b in chain(batches, [None]):
        if b is not None and not len(b):
            continue
        if b is None:
            done, held = held, []
        else:
            lead = b.column("lead").to_numpy()
            cut = int(np.flatnonzero(lead == lead[-1])[0])
            if held and not cut and held[0].column("lead")[0].as_py() == lead[0]:
                held.append(b)
                continue
            done, held = [*held, b.slice(0, cut)], [b.slice(cut)]
        if not sum(map(len, done)):
            continue
        rows = pa.Table.from_batches(done)
        lead = rows.column("lead").to_numpy()
        at = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1], True])
        out = [work(rows.slice(i, j - i)) for i, j in zip(at[:-1], at[1:], strict=True) if j - i > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])


def _unconnected(delta: DataFrame) -> DataFrame:
    """(a, b): pairs of members of one leader, of different components c, among them all with a similarity of 4/5 or more.

    `delta` holds the shingles in which a member differs from its leader: those it has besides and those it lacks.
    They are put in one order for all members, those in the fewest deltas in front (see _by_rarity()).
    Texts a and b are 4/5 alike if they differ in (n_a + n_b) / 9 shingles at most, that is, if their deltas share
    (e_a + e_b) / 18 or more, where e = 9 * size(delta) - n.  A member is linked to its leader if e <= n_lead, and
    e >= -n_lead for any; so a pair that isn't linked through the leader shares at least one shingle, and the first one that
    they share must stand so far in front that enough can follow: in the first n / 9 or so of the member with the lesser e.
    Variants of a text made by different edits share none there, so a group's pairs aren't written.  No order loses a pair.
    Up to TOGETHER members of a leader are compared in one task instead, without a row for a shingle.
    """
    small = ((F.count("*") <= TOGETHER) & (F.sum(F.size("delta")) <= IN_ALL)).alias("small")
    split = delta.groupBy("lead").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), small).where("lo <> hi").select("lead", "small")
    d = saved(delta.join(split, "lead").select("lead", "node", "n", "n_lead", "c", "delta", "small"))
    few = d.where("small").select("lead", "node", "n", "c", "delta").repartition("lead").sortWithinPartitions("lead")
    few = saved(few.mapInArrow(_alike, "a long, b long"))
    d = d.where("not small")
    if d.isEmpty():
        return few
    d = _by_rarity(d.select("lead", "node", "n", "n_lead", "c", "delta"))
    # shingles of one delta only come first of all; they match nothing, so their number will do
    size, lone = F.size("delta").alias("size"), (F.size("delta") - F.size("rest")).alias("lone")
    d = saved(d.select("lead", "node", "n", "n_lead", "c", lone, size, (9 * F.size("delta") - F.col("n")).alias("e"), "rest"))

    def front(rows: DataFrame, least: Column, x: str) -> DataFrame:
        """A row per shingle that may be the first shared one where deltas share least / 18 or more; `left` follow it."""
        far = F.floor((18 * F.col("size") - least) / 18) + 1 - F.col("lone")
        p = rows.select("*", F.posexplode(F.slice("rest", F.lit(1), F.greatest(far, F.lit(0)).cast("int"))).alias("at", "shingle"))
        return p.select("lead", "shingle", *[F.col(k).alias(f"{k}_{x}") for k in ("node", "n", "c", "e")], (F.col("size") - F.col("lone") - 1 - F.col("at")).alias(f"left_{x}"))

    a = front(d, F.greatest(2 * F.col("e"), F.col("e") + F.col("n_lead")), "a")
    b = front(d.where("e > n_lead"), F.col("e") - F.col("n_lead"), "b")
    order = (F.col("e_a") < F.col("e_b")) | ((F.col("e_a") == F.col("e_b")) & (F.col("node_a") < F.col("node_b")))
    sizes = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    enough = 18 * (1 + F.least("left_a", "left_b")) >= F.col("e_a") + F.col("e_b")
    met = a.join(b, ["lead", "shingle"]).where(order & (F.col("c_a") != F.col("c_b")) & sizes & enough)
    met = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return saved(met.union(few).distinct())


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of near_links() stays, the one with the smallest doc_id (nulls last).  Columns as those of docs.

    Rows that share a doc_id but not the text are documents of their own; of those in one group the least text hash stays.
    """
    group = components(near_links(docs))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("th"))
    named = ids.join(group, ids["th"] == group["node"], "left").withColumn("c", F.coalesce("component", "th"))
    first = named.groupBy("c").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("one"))
    # the same keys for the join and for repeated rows, so that the texts are shuffled once; as a struct they would be cast, and shuffled again
    keys = ["__tidemark_none", "__tidemark_id", "__tidemark_th"]
    one = first.select("one.none", F.coalesce("one.doc_id", F.lit(0)), "one.th").toDF(*keys)
    own = F.col("doc_id").cast("long")
    d = docs.withColumns(dict(zip(keys, [F.isnull(own), F.coalesce(own, F.lit(0)), F.xxhash64(body())], strict=True)))
    return d.join(one.hint("shuffle_hash"), keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
