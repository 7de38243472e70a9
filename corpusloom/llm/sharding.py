"""Sharding (operator 3) by balanced label propagation. Law: rows (counts at most one apart).

Documents are linked if they share a key (here: equal texts). They start dealt out evenly, in
the order of a hash. In each round every document votes for the shard where most of its
neighbours are (its keys' counts by shard, so no pairs are made); the proposals of a shard are
taken in the order of a hash, whole keys at a time, as far as the shard's quota of room goes.
Documents without links are the ballast that makes room. At the end keys that a shard took
stay there; keys that found no room, or are larger than a shard, are laid out side by side over
the room left, so that they are cut only where a shard ends; ballast fills the rest. The counts
are then even to one row by construction.

Ranks and prefix sums are taken in two levels (see ranked), so that no task holds a shard or a
hot key. Only the counts of the shards come to the driver: a number for each.

Edge cases: null texts are of size 1 and linked with nothing; empty texts are a group like any
other equal texts; repeated rows are rows of their own, in one group; with fewer rows than
shards some shards are empty; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, ranked, table

SHARDS, ROUNDS = 16, 3
LAW = "rows"


def _slice_of(position: Column, ends: list[int]) -> Column:
    """Index of the interval [ends[i-1], ends[i]) that holds the position."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= position)).cast("int")


def balanced_labels(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows(row, grp): row, any id that tells rows apart as well as can be; grp, the link key or null -> (row, grp, shard, slot)."""
    scratch = Scratch(rows.sparkSession)
    rows = scratch.cut(rows)
    n = rows.count()
    room = [n // shards + (k < n % shards) for k in range(shards)]
    many = buckets_for(n)
    groups = rows.where("grp is not null").groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    groups = scratch.cut(groups)

    # the even start: the place of each linked row in a hash order decides its shard; of all rows of a key, only counts by shard are kept
    linked = rows.join(groups, "grp")
    first = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(shards)).cast("int")
    held = scratch.cut(linked.groupBy("grp", first.alias("shard")).agg(F.count("*").alias("k"), F.count("*").alias("vote")).withColumn("done", F.lit(False)))
    for step in range(rounds):
        # votes of a key's rows: the shard that holds most of their neighbours; ties by a hash of the round
        best = held.where("not done").groupBy("grp").agg(F.max(F.struct(F.col("vote"), F.xxhash64("grp", "shard", F.lit(step)).alias("tie"), F.col("shard"))).alias("best"), F.sum("k").alias("size"))
        full = dict(held.where("done").groupBy("shard").agg(F.sum("k").alias("n")).collect())  # a number for each shard
        quota = [room[k] - full.get(k, 0) for k in range(shards)]
        asks = best.select("grp", F.col("best.shard").alias("to"), "size")
        bucket = F.pmod(F.xxhash64("grp", F.lit(step + 100)), F.lit(buckets_for(max(1, n // 4))))
        asks = ranked(asks, bucket.cast("long"), [F.col("size"), F.col("grp")], ["to"], "before", F.col("size"))
        limits = F.array(*[F.lit(q).cast("long") for q in quota])
        moved = asks.where(F.col("before") + F.col("size") <= F.element_at(limits, F.col("to") + 1)).select(F.col("grp").alias("g"), "to")
        after = held.join(moved, F.col("grp") == F.col("g"), "left")
        after = after.groupBy("grp", F.coalesce("to", "shard").alias("shard")).agg(F.sum("k").alias("k"), F.sum("vote").alias("vote"), (F.max("done") | F.max("to").isNotNull()).alias("done"))
        # a key that found no room there votes for another shard in the next round
        refused = asks.where(F.col("before") + F.col("size") > F.element_at(limits, F.col("to") + 1)).select(F.col("grp").alias("g"), "to")
        after = after.join(refused, (F.col("grp") == F.col("g")) & (F.col("shard") == F.col("to")), "left").select("grp", "shard", "k", F.when(F.col("g").isNull(), F.col("vote")).otherwise(-1).alias("vote"), "done")
        after = scratch.cut(after)
        scratch.drop(held)
        held = after
    sizes = groups.withColumnRenamed("grp", "g")
    settled = scratch.cut(held.where("done").select(F.col("grp").alias("g"), "shard", F.col("k").alias("size")))
    used = dict(settled.groupBy("shard").agg(F.sum("size").alias("n")).collect())
    free = list(accumulate(room[k] - used.get(k, 0) for k in range(shards)))

    # all others, keys first: their places in one order fill the room left
    named = rows.join(sizes, F.col("grp") == F.col("g"), "left").drop("g").join(settled.select("g", F.col("shard")), F.col("grp") == F.col("g"), "left").drop("g")
    named = scratch.cut(named)
    rest = named.where("shard is null").select("row", "grp", "size")
    key = F.when(F.col("size").isNotNull(), F.shiftrightunsigned(F.xxhash64("grp"), 34)).otherwise(F.shiftrightunsigned(F.xxhash64("row"), 34))
    level = F.floor(key * many / F.lit(2**30))
    # within a bucket come whole keys; a key too large for a task is cut up by its rows' hash
    fine = F.when(F.col("size") > 4096, F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1023)) + 1).otherwise(0)
    bucket = F.when(F.col("size") > 4096, key * 1024 + fine).otherwise(F.lit(2**41) + F.when(F.col("size").isNull(), F.lit(2**41)).otherwise(0) + level)
    placed = ranked(rest.withColumn("key", key), bucket.cast("long"), [F.col("key"), F.col("grp"), F.col("row")], [], "place").drop("key")
    placed = placed.select("row", "grp", _slice_of(F.col("place"), free).alias("shard"))
    both = scratch.cut(named.where("shard is not null").select("row", "grp", "shard").unionByName(placed))
    slots = ranked(both, F.pmod(F.xxhash64("row"), F.lit(many)).cast("long"), [F.col("row")], ["shard"], "slot")
    return slots.select("row", "grp", F.col("shard").cast("int").alias("shard"), "slot")


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs; linked by equal texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = F.struct(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = balanced_labels(docs.select(facts.alias("row"), F.md5(F.col(text).cast("binary")).alias("grp")), shards)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
