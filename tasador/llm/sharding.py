"""Balanced label propagation: linked documents move to one shard, sizes stay even.

Documents start in shards by a hash. In each round every group of linked
documents names the shard that holds most of it and still has room for the rest;
its members move there as far as that shard's quota goes. What no group holds
then fills the shards up to the same size. All of it is DataFrame work; only
loads per shard and counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasador.plans.blocks import positions
from tasador.plans.joins import checked_join, sized_join
from tasador.plans.lineage import cut_lineage, cut_measured

SHARDS = 24
ROUNDS = 8
BUCKETS = 2048
LAST_ITEMS = 4096  # as many are dealt one by one, the largest first
HEAVY = 8  # a group above one part in so many of a shard may move in parts


def _array(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")


def _of(values: Sequence[int], shard: Column) -> Column:
    return F.element_at(_array(values), shard + 1)


def _bucket(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), BUCKETS).cast("int")


def _loads(items: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["load"] for r in items.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _level(loads: Sequence[int], extra: int) -> list[int]:
    """What each shard takes of ``extra`` so that the lowest loads rise to one level."""
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    filled, takes = sum(loads) + extra, [0] * len(loads)
    while order:
        level = filled // len(order)
        if loads[order[-1]] <= level:
            break
        filled -= loads[order.pop()]
    for i, s in enumerate(sorted(order)):
        takes[s] = level + (i < filled % len(order)) - loads[s]
    return takes


def propagate(members: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, shard) of every node of ``members`` (node, group, size).

    A node may belong to several groups; its groups' votes are added up and ties
    go to the smaller shard. ``capacity`` bounds what may move into a shard.
    Groups larger than that are cut by a hash of the node beforehand. A round in which
    nothing moves is the last.
    """
    weights = members.groupBy("group").agg(F.sum("size").alias("whole"))
    large = weights.where(F.col("whole") > capacity).select(
        "group", F.ceil(F.col("whole") * 5 / F.lit(max(1, 4 * capacity))).cast("int").alias("_pieces")  # four fifths full
    )
    # at most the sum of all sizes over the capacity, a few dozen, unless nodes have many groups
    cut = checked_join(members, large, ["group"], "left", salt=["node"])
    piece = F.coalesce(F.pmod(F.xxhash64("node"), F.col("_pieces")), F.lit(0))
    state = cut_lineage(
        cut.select(
            "node", "size", F.xxhash64("group", piece).alias("vote"), F.pmod(F.xxhash64("node"), shards).cast("int").alias("shard")
        ),
        "labels",
    )
    for number in range(rounds):
        state, moved = _round(state, capacity, shards, number)
        if not moved:
            break
    return state.select("node", "size", "shard").dropDuplicates(["node"])


def _round(state: DataFrame, capacity: int, shards: int, number: int) -> tuple[DataFrame, int]:
    """One round: votes of groups, wishes of nodes, quotas of shards."""
    loads = _loads(state.dropDuplicates(["node"]), shards)
    room = [max(0, capacity - load) for load in loads]
    held = state.groupBy("vote", "shard").agg(F.sum("size").alias("w"))
    # at most one entry a shard
    groups = held.groupBy("vote").agg(
        F.sum("w").alias("whole"), F.collect_list(F.struct("shard", "w")).alias("entries")
    ).where(F.size("entries") > 1)
    other = F.pmod(F.xxhash64("vote", F.lit(number)), shards).cast("int")
    entries = F.concat(
        "entries",
        F.when(
            F.exists("entries", lambda e: e["shard"] == other), F.expr("array()").cast("array<struct<shard:int,w:bigint>>")
        ).otherwise(F.array(F.struct(other.alias("shard"), F.lit(0).cast("bigint").alias("w")))),
    )
    ranked = F.transform(
        entries,
        lambda e: F.struct(
            (_of(room, e["shard"]) >= F.col("whole") - e["w"]).alias("fits"),
            (_of(room, e["shard"]) > 0).alias("open"),
            e["w"].alias("w"),
            F.xxhash64("vote", e["shard"]).alias("tie"),
            e["shard"].alias("shard"),
        ),
    )
    votes = groups.select(
        "vote", "whole", F.map_from_entries("entries").alias("held"), F.array_max(ranked).alias("best")
    ).where("best.open")
    joined = checked_join(state, votes, ["vote"], "left", salt=["node"])
    wish = F.when(
        (F.col("best.shard") != F.col("shard"))
        & (F.col("best.fits") | (F.element_at("held", F.col("shard")) < F.col("best.w"))),
        F.col("best.shard"),
    )
    heavy = F.col("whole") > capacity // HEAVY
    order = F.when(heavy, F.xxhash64("node")).otherwise(F.col("vote"))
    wishes = joined.where(wish.isNotNull()).select(
        "node", "size", wish.alias("to"), F.col("best.w").alias("w"), _bucket(order, F.lit(number)).alias("bucket")
    )
    wishes = wishes.groupBy("node", "to").agg(
        F.sum("w").alias("w"), F.max("size").alias("size"), F.min("bucket").alias("bucket")
    )
    wishes = wishes.groupBy("node").agg(
        F.max(F.struct("w", -F.col("to"), "size", "bucket")).alias("m")
    ).select("node", (-F.col("m")["col2"]).alias("to"), "m.size", "m.bucket")
    wishes = cut_lineage(wishes, "wishes")
    sums = wishes.groupBy("to", "bucket").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    accepted = sums.withColumn("end", F.sum("size").over(upto)).where(F.col("end") <= _of(room, F.col("to")))
    # shards x buckets rows at most
    moves = wishes.join(F.broadcast(accepted.select("to", "bucket")), ["to", "bucket"], "left_semi").select("node", "to")
    moves, found = cut_measured(moves, "moves", rows=F.count("*"))
    after = sized_join(state, moves, found, ["node"], "left")
    return cut_lineage(after.select("node", "size", "vote", F.coalesce("to", "shard").alias("shard")), "labels"), found["rows"]


def _shed(linked: DataFrame, level: Sequence[int], shards: int) -> tuple[DataFrame, DataFrame]:
    """Linked nodes that stay, and those that leave shards above their level."""
    over = [max(0, load - top) for load, top in zip(_loads(linked, shards), level)]
    if not any(over):
        return linked, linked.limit(0)
    keyed = linked.withColumn("bucket", _bucket("node", F.lit("shed")))
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy("shard", "bucket").agg(F.sum("size").alias("load")).withColumn("end", F.sum("load").over(upto))
    leaving = sums.where(F.col("end") - F.col("load") < _of(over, F.col("shard"))).select("shard", "bucket", F.lit(True).alias("leaves"))
    told = cut_lineage(keyed.join(F.broadcast(leaving), ["shard", "bucket"], "left").drop("bucket"), "shed")
    return told.where("leaves is null").drop("leaves"), told.where("leaves").drop("leaves")


def _deal_last(items: DataFrame, room: Sequence[int]) -> DataFrame:
    """At most LAST_ITEMS rows: the largest first, each to the shard with most room."""
    listed = items.groupBy().agg(F.sort_array(F.collect_list(F.struct("size", "node")), asc=False).alias("items"))
    best = lambda acc: F.array_position(acc["room"], F.array_max(acc["room"]))
    dealt = F.aggregate(
        "items",
        F.struct(_array(room).alias("room"), F.expr("array()").cast("array<int>").alias("picks")),
        lambda acc, x: F.struct(
            F.transform(acc["room"], lambda r, i: F.when(i + 1 == best(acc), r - x["size"]).otherwise(r)).alias("room"),
            F.concat(acc["picks"], F.array((best(acc) - 1).cast("int"))).alias("picks"),
        ),
        lambda acc: acc["picks"],
    )
    pairs = listed.select(F.explode(F.arrays_zip(F.col("items").alias("item"), dealt.alias("pick"))).alias("p"))
    picks = pairs.select(F.col("p.item.node").alias("node"), F.col("p.pick").alias("shard"))
    return items.join(F.broadcast(picks), "node")


def fill(pool: DataFrame, loads: Sequence[int]) -> list[DataFrame]:
    """``pool`` (node, size, ...) with the ``shard`` that brings all loads to one level, in parts.

    Hashed buckets are laid end to end over what the shards lack; a bucket that
    lies inside one shard's stretch goes there. Those on a border, a hundredth, are dealt
    again in smaller buckets.
    """
    parts, loads, turn = [], list(loads), 0
    found = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    while found["n"]:
        takes = _level(loads, found["size"])
        if found["n"] <= LAST_ITEMS:
            parts.append(_deal_last(pool, takes))
            break
        ends = [sum(takes[: s + 1]) for s in range(len(takes))]
        keyed = pool.withColumn("bucket", _bucket("node", F.lit(turn)))
        sums = keyed.groupBy("bucket").agg(F.sum("size").alias("size"))
        upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        # the first shard whose stretch ends behind the bucket also has to hold its beginning
        shard = F.array_position(F.transform(_array(ends), lambda e: e >= F.col("end")), F.lit(True)).cast("int") - 1
        start = F.col("end") - F.col("size")
        stretch = sums.withColumn("end", F.sum("size").over(upto)).select("bucket", "size", "end", shard.alias("shard"))
        inside = F.when(F.col("shard") >= 0, start >= _of(ends, F.col("shard")) - _of(takes, F.col("shard")))
        told = stretch.select("bucket", F.when(inside, F.col("shard")).alias("shard"))
        dealt = cut_lineage(keyed.join(F.broadcast(told), "bucket").drop("bucket"), "dealt")
        parts.append(dealt.where("shard is not null"))
        loads = [a + b for a, b in zip(loads, _loads(parts[-1], len(loads)))]
        pool, turn = dealt.where("shard is null").drop("shard"), turn + 1
        found = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return parts


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows) of every row of ``docs``.

    The law is ``bytes``: the summed sizes of the shards, UTF-8 bytes plus 8 a row, differ by
    about one small document. Rows of equal texts are linked and share a
    shard unless they need more than one; a null text counts as an empty one, its crc32 is 0.
    Null and repeated ids are rows like others; slots follow the ids. Extra columns are
    ignored, an empty table gives no rows. A document larger than a shard's
    share has a shard above the level; the others are level. A row's place depends on
    how the table is split into partitions, its group's unity does not.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
        F.monotonically_increasing_id().alias("node"),
    )
    rows, found = cut_measured(rows, "rows", total=F.sum("size"))
    copies = rows.groupBy("group").agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    rows = checked_join(rows, copies, ["group"], "left", salt=["node"])
    rows = cut_lineage(rows.withColumn("group_rows", F.coalesce("group_rows", F.lit(1).cast("long"))), "rows")
    level = _level([0] * shards, found["total"] or 0)
    linked = propagate(rows.where("group_rows > 1").select("node", "group", "size"), min(level), shards, rounds)
    stay, leave = _shed(cut_lineage(linked, "linked"), level, shards)
    plain = rows.where("group_rows = 1").select("node", "size")
    parts = fill(plain.unionByName(leave.select("node", "size")), _loads(stay, shards))
    placed = stay.select("node", "shard")
    for part in parts:
        placed = placed.unionByName(part.select("node", "shard"))
    placed = rows.drop("group").join(placed, "node")
    numbered = positions(placed, ["shard"], ["doc_id", "node"], "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_rows",
    )
