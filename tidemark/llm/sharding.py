"""Balanced label propagation over linked documents (DataFrame functions only)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import body, forget, hash128, load, saved

#: Shards, and rounds of propagation after which it warns that it hasn't settled.
SHARDS, ROUNDS = 16, 40
#: Parts that a group's rows are dealt to in joins on the group, so that a giant group isn't one task.
SALTS = 16
#: Rows of a shard while labels move, as a share of its quota; the last step evens the counts out.
SLACK = 1.15


def _ranked(rows: DataFrame, part: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Rank of each row in its part by (bucket, order), from 0.  No task holds more than one bucket of one part."""
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy(part, "_b").agg(F.count("*").alias("_n"))
    # parts x buckets rows, a fixed number
    w = Window.partitionBy(part).orderBy("_b")
    base = counts.select(F.col(part).alias("_s"), F.col("_b").alias("_b2"), (F.sum("_n").over(w) - F.col("_n")).alias("_base"))
    rows = rows.join(F.broadcast(base), (F.col(part) == F.col("_s")) & (F.col("_b") == F.col("_b2")))
    inner = F.row_number().over(Window.partitionBy(part, "_b").orderBy(*order)) - 1
    return rows.withColumn(name, (F.col("_base") + inner).cast("long")).drop("_b", "_b2", "_s", "_base")


def _bits(c: str, n: int) -> Column:
    """n bits of a hash, from the top."""
    return F.shiftrightunsigned(c, 64 - n).cast("int")


def _salt(uid: str) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(SALTS)).cast("int")


def _grants(asks: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Moves allowed from shard to shard: what both of a pair ask of each other is exchanged; the rest goes by the room left."""
    out = {p: min(n, asks.get(p[::-1], 0)) for p, n in asks.items()}
    room = list(free)
    for (a, b), n in sorted(asks.items(), key=lambda x: (-x[1], x[0])):
        more = max(0, min(n - out[a, b], room[b]))
        out[a, b] += more
        room[b] -= more
        room[a] += more
    return {p: n for p, n in out.items() if n}


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot): shards whose row counts differ by one at most.

    Documents with equal texts are linked.  Each starts in a shard by hash.  In a round every linked document counts
    its group's members by shard and asks for the shard that holds the most of them, in every second round for the one that
    does among those with room.  Two shards exchange as many documents as both ask of each other; other moves are
    granted up to the room left, SLACK times a shard's quota.  A group larger than a shard so fills one shard after
    another.  Each move raises the number of linked pairs that share a shard, so it settles; where it hasn't after
    `rounds`, it warns.  Then rows beyond a shard's quota, unlinked ones first and after them whole groups, go to
    shards below theirs.
    size: UTF-8 bytes plus 1; text_crc32: unsigned, of the UTF-8 text; null texts count as empty, and are linked with
    each other.  Repeated rows are documents of their own; null doc_ids are placed as others.  slot runs from 0 without
    gaps in each shard.  An empty table gives an empty table.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("t"))
    d = d.select("doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), hash128(F.col("t")).alias("k"))
    d = saved(d.withColumn("uid", F.monotonically_increasing_id()).withColumn("salt", _salt("uid")))
    groups = d.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    spread = groups.select(F.col("k").alias("_k"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    v = d.join(spread, (F.col("k") == F.col("_k")) & (F.col("salt") == F.col("_salt")), "left").withColumn("linked", F.col("_k").isNotNull())
    v = v.withColumn("r", F.xxhash64("uid", "doc_id")).withColumn("grp", F.xxhash64("k"))
    v = saved(v.select("uid", "k", "grp", "linked", "r", "salt", F.pmod("r", F.lit(shards)).cast("int").alias("shard")))
    total = v.count()
    fine = min(9, max(3, (total >> 20).bit_length()))  # more and smaller buckets for more rows
    room = -(-total * int(100 * SLACK) // (100 * shards))
    moving, idle = saved(v.where("linked")), 0
    for i in range(rounds):
        held = saved(moving.groupBy("k", "shard").agg(F.count("*").alias("n")))
        load_ = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard
        free = [room - load_.get(s, 0) for s in range(shards)]
        among = held.where(F.col("shard").isin([s for s in range(shards) if free[s] > 0])) if i % 2 else held
        # of equal counts the shard by a hash of the group, so that ties don't fill the first shards
        best = among.groupBy(F.col("k").alias("_k")).agg(F.max(F.struct("n", F.xxhash64("k", "shard").alias("x"), "shard")).alias("top")).select("_k", F.col("top.n").alias("most"), F.col("top.shard").alias("to"))
        own = held.select(F.col("k").alias("_k2"), F.col("shard").alias("_s2"), F.col("n").alias("here"))
        ask = best.join(own, F.col("_k") == F.col("_k2")).where((F.col("to") != F.col("_s2")) & (F.col("here") <= F.col("most")))
        ask = saved(ask.select("_k", "_s2", "to", "here"))
        pairs = {(r["_s2"], r["to"]): r["n"] for r in ask.groupBy("_s2", "to").agg(F.sum("here").alias("n")).collect()}  # pairs of shards
        allowed = _grants(pairs, free)
        forget(held)
        if not allowed:
            forget(ask)
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        quota = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * shards + b, n)])
        wants = moving.join(ask.select("_k", "_s2", "to"), (F.col("k") == F.col("_k")) & (F.col("shard") == F.col("_s2")))
        wants = wants.select("uid", "grp", "r", "to", (F.col("shard") * shards + F.col("to")).alias("way"))
        wants = _ranked(wants, "way", _bits("grp", 5) * 8 + _bits("r", 3), ["grp", "uid"], "rank")
        granted = wants.where(F.col("rank") < F.coalesce(F.try_element_at(quota, F.col("way")), F.lit(0))).select(F.col("uid").alias("_u"), "to")
        last, moving = moving, saved(moving.join(granted, F.col("uid") == F.col("_u"), "left").select("uid", "k", "grp", "linked", "r", "salt", F.coalesce("to", "shard").alias("shard")))
        forget(last), forget(ask)
    else:
        warnings.warn(f"balanced label propagation: labels still moved after {rounds} rounds", stacklevel=2)
    placed = v.where("not linked").unionByName(moving)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    by_group = F.when(F.col("linked"), _bits("grp", 7) + 1).otherwise(_bits("r", 3) - 8)  # linked rows stay first, so unlinked ones go first
    spare = F.when(F.col("linked"), 0).otherwise(256)
    placed = _ranked(placed, "shard", (spare + by_group) * (1 << fine) + _bits("r", fine), ["grp", "uid"], "rank")
    placed = saved(placed.select("uid", "grp", "r", "shard", "rank"))
    have = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    q = F.array(*[F.lit(x).cast("long") for x in quota])
    stay = placed.where(F.col("rank") < F.get(q, F.col("shard"))).select("uid", "grp", "r", "shard")
    over = placed.where(F.col("rank") >= F.get(q, F.col("shard"))).withColumn("one", F.lit(0))
    over = _ranked(over, "one", _bits("grp", 9) * (1 << fine) + _bits("r", fine), ["grp", "uid"], "i")
    to, at = F.lit(None).cast("int"), sum(max(0, quota[s] - have.get(s, 0)) for s in range(shards))
    for s in reversed(range(shards)):
        at -= max(0, quota[s] - have.get(s, 0))
        to = F.coalesce(F.when((F.col("i") >= at) & (F.col("i") < at + max(0, quota[s] - have.get(s, 0))), F.lit(s)), to)
    done = stay.union(over.select("uid", "grp", "r", to.alias("shard")))
    done = _ranked(done, "shard", _bits("r", 7 + fine), ["uid"], "slot")
    out = d.join(done.select(F.col("uid").alias("_u"), "grp", "shard", "slot"), F.col("uid") == F.col("_u"))
    out = saved(out.select("doc_id", "size", "text_crc32", "grp", "shard", "slot"))
    for x in (d, v, moving, placed):
        forget(x)
    return out


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
