"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Every document starts in a shard by the hash of its id.  In each round a linked document asks for the
shard in which most of its neighbours are, among those that still have room; requests are admitted by
gain up to the room of the shard, so linked documents never crowd a shard beyond its quota.  Documents
without links cost nothing to move: at the end they even out the shards, so that counts differ by one at most.

All tables that cross the shuffle are narrow.  A group may hold a third of all rows: its members are
counted by partial aggregates and joined to one row of the group, a join whose large side Spark may split.
Tables that are broadcast have at most shards x 160 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import saved

SPREAD = 4  # parts of each gain level, so that admission can stop inside a level


def _shares(requests: DataFrame, room: DataFrame) -> DataFrame:
    """(target, level, share): which part of the requests of a level the room of the target admits."""
    levels = requests.groupBy("target", "level").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("target").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        levels.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(F.broadcast(room), "target")
        .select("target", "level", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_room") - F.col("_before")) / F.col("_n"))).alias("_share"))
    )


def _round(linked: DataFrame, shards: int, quota: int, number: int) -> tuple[DataFrame, int, int]:
    """One round over the linked documents: their new shards, the number of requests, the rooms left."""
    counts = linked.groupBy("link", "shard").agg(F.count("*").alias("n"))
    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # admission by chance meets a room only about; a shard with less left than that counts as full
    least = max(1, 2 * math.isqrt(quota))
    room = {s: r if (r := quota - held.get(s, 0)) >= least else 0 for s in range(shards)}
    open_shards = [s for s in range(shards) if room[s] > 0]
    if not open_shards:
        return linked, 0, 0
    spark = linked.sparkSession
    rooms = spark.createDataFrame([(s, room[s]) for s in range(shards)], "target int, _room long")
    # one row per group: neighbours by shard, and the best open shard; ties go to the shard that the group's hash prefers
    groups = counts.groupBy("link").agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("_by"),
        F.max(F.when(F.col("shard").isin(open_shards), F.struct("n", F.xxhash64("link", "shard").alias("h"), "shard"))).alias("_best"),
    ).filter(F.col("_best").isNotNull() & (F.size("_by") > 1))
    groups = saved(groups.select("link", "_by", F.col("_best.shard").alias("target"), F.col("_best.n").alias("_goal")), "shard_targets")
    asked = linked.join(groups, "link", "left").withColumn("_gain", F.col("_goal") - F.element_at("_by", F.col("shard")))
    # members elsewhere ask for the group's shard when more neighbours are there, or as many and the hash decides
    wants = F.col("target").isNotNull() & (F.col("target") != F.col("shard")) & (F.col("_gain") >= 0)
    level = (F.floor(F.log2(F.col("_gain") + 1)) * SPREAD + F.pmod(F.xxhash64("link"), F.lit(SPREAD))).cast("int")
    asked = asked.select(
        *linked.columns, F.when(wants, F.col("target")).alias("target"), F.when(wants, level).alias("level")
    )
    requests = asked.filter(F.col("target").isNotNull())
    shares = _shares(requests, rooms).filter("_share > 0")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(number)), F.lit(1_000_000)) / 1_000_000
    moved = asked.join(F.broadcast(shares), ["target", "level"], "left").withColumn(
        "_new", F.when(F.col("_share").isNotNull() & (chance < F.col("_share")), F.col("target")).otherwise(F.col("shard"))
    )
    out = saved(moved.select(*[F.col("_new").alias("shard") if c == "shard" else F.col(c) for c in linked.columns], (F.col("_new") != F.col("shard")).alias("_moved")), "shard_round")
    return out.drop("_moved"), out.filter("_moved").count(), len(open_shards)


def cut_links(placed: DataFrame) -> DataFrame:
    """(links, cut): pairs of documents of one group, and those of them in different shards, from counts only."""
    c = placed.filter(F.col("link").isNotNull()).groupBy("link", "shard").agg(F.count("*").alias("n"))
    g = c.groupBy("link").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    return g.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("links"), F.sum(F.col("m") * (F.col("m") - 1) / 2 - F.col("same")).alias("cut"))


def balanced_shards(docs: DataFrame, shards: int, link: str = "link", rounds: int = 12, bucket_rows: int = 20_000) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to rows with ``doc_id`` and a link key.

    Rows with equal link keys are neighbours; a null key, or one that no other row has, means no neighbour.
    Shard sizes in rows differ by one at most.  Repeated rows are placed one by one, null ids like any
    other value.  An empty table gives an empty table.  ``rounds`` is a limit; it stops when nothing moves.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", link)]
    base = docs.select("doc_id", F.col(link).alias("link"), *rest, F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    many = base.filter(F.col("link").isNotNull()).groupBy("link").agg(F.count("*").alias("_m")).filter("_m > 1")
    many = saved(many, "shard_groups")  # read back, so that the join below gets plain exchanges, which Spark can split
    base = saved(base.join(many, "link", "left").withColumn("_linked", F.col("_m").isNotNull()).drop("_m"), "shard_base")
    total = base.count()
    quota = total // shards
    linked, single = base.filter("_linked"), base.filter("not _linked")
    for number in range(rounds):
        linked, moved, rooms = _round(linked, shards, quota, number)
        if moved == 0 or rooms == 0:
            break
    return _evened(linked.unionByName(single), total, shards, bucket_rows).drop("_linked")


def _evened(placed: DataFrame, total: int, shards: int, bucket_rows: int) -> DataFrame:
    """Number the rows of each shard, linked ones first; what exceeds the quota fills the other shards."""
    buckets = max(8, total // shards // bucket_rows + 1)
    # linked rows lie in buckets by group, so that a group stays together where a quota cuts
    bucket = F.when(F.col("_linked"), F.pmod(F.xxhash64("link"), F.lit(buckets))).otherwise(buckets + F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets)))
    spread = F.when(F.col("_linked"), F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets))).otherwise(F.lit(0))
    rows = placed.withColumns({"_bucket": bucket.cast("int"), "_spread": spread.cast("int")})
    sizes = rows.groupBy("shard", "_bucket", "_spread").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket", "_spread").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_bucket", "_spread").orderBy(F.xxhash64("link", "doc_id"), "doc_id")
    at = rows.join(starts, ["shard", "_bucket", "_spread"]).withColumn("_at", F.col("_start") + F.row_number().over(inside) - 1)

    held = {r["shard"]: r["_n"] for r in sizes.groupBy("shard").agg(F.sum("_n").alias("_n")).collect()}
    count = {s: held.get(s, 0) for s in range(shards)}
    # the shards that hold most take the rows that the division leaves over
    extra = set(sorted(range(shards), key=lambda s: (-count[s], s))[: total % shards])
    quota = {s: total // shards + (s in extra) for s in range(shards)}
    out_from, place, gaps = {}, 0, []
    for s in range(shards):
        out_from[s] = place
        place += max(0, count[s] - quota[s])
    place = 0
    for s in range(shards):
        if quota[s] > count[s]:
            gaps.append((place, s, count[s]))
            place += quota[s] - count[s]
    by_shard = lambda d: F.element_at(F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(d[s]).cast("long"))]), F.col("shard"))
    over = F.col("_at") - by_shard(quota)
    leaver = by_shard(out_from) + over
    new_shard, new_slot = F.col("shard"), F.col("_at")
    for first, s, taken in gaps:
        new_shard = F.when((over >= 0) & (leaver >= first), F.lit(s)).otherwise(new_shard)
        new_slot = F.when((over >= 0) & (leaver >= first), leaver - first + taken).otherwise(new_slot)
    # the last gap that starts at or before a leaver is its own: later conditions were put outside
    return at.withColumns({"_shard": new_shard.cast("int"), "slot": new_slot.cast("long")}).drop("shard", "_bucket", "_spread", "_start", "_at").withColumnRenamed("_shard", "shard")
