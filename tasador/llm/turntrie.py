"""Prefix trie of conversations from padded matrices of turn ids.

A turn becomes a 16-byte id. Conversations are dealt to shards by ranges of their id
sequences; inside a shard they are the rows of a padded matrix that numpy's lexsort
orders. Where a column differs from the row above, a node starts there and
at every later column: OR-accumulated change masks. Per depth, reduceat sums
what the rows of a node bring. Nodes that go on in the next shard are
added up afterwards. Conversations longer than a matrix is wide go on in a matrix
of their own below the node they have reached, deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasador.plans.blocks import positions, range_blocks
from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_lineage, cut_measured

WIDTH = 512
ID_BYTES = 16
EVERY = 5  # conversations so far apart lend their first turns
MOST_LENT = 9
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "least_more long, ends_sha256 string, key binary, parent_key binary, block int, ends string"
)
_NONE = np.iinfo(np.int64).max
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, k1, k2, size): turns from 0 on, null first, ties by role and text; rows without a conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("k1"),
        F.xxhash64(F.lit(2), text, role).alias("k2"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return cut_lineage(positions(turns, ["conv_id"], ["turn", "k1", "k2"], "at").drop("turn"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, k1, k2, size) of the rebuilt conversations, and every (conv_id, length).

    A conversation starts with the first crc32(conv_id) mod 9 turns of the one
    whose id is the next lower multiple of 5, and goes on with its own turns after as many.
    """
    lengths = cut_lineage(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "lengths")
    lender = F.col("conv_id") - F.pmod("conv_id", F.lit(EVERY))
    convs = lengths.select("conv_id", "own", lender.alias("lender"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_LENT).alias("h"))
    lent = lengths.select(F.col("conv_id").alias("lender"), F.col("own").alias("there"))
    convs = convs.join(lent, "lender", "left").select(
        "conv_id", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lent")
    )
    convs = cut_lineage(convs, "rebuilt")
    keep = ["conv_id", "depth", "k1", "k2", "size"]
    first = turns.where((F.pmod("conv_id", F.lit(EVERY)) == 0) & (F.col("at") < MOST_LENT - 1))
    first = first.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(EVERY - 1)), lambda i: F.col("conv_id") + i)))
    first = first.join(convs, "conv_id").where("at < h").withColumn("depth", F.col("at") + 1)
    # the table of lengths is as long as there are conversations: measured, broadcast or salted
    own = checked_join(turns, convs, ["conv_id"], salt=["at"]).where("at >= h")
    own = own.withColumn("depth", F.col("lent") + F.col("at") - F.col("h") + 1)
    length = F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return first.select(keep).unionByName(own.select(keep)), convs.select("conv_id", length.alias("length"))


def segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and ``width`` turns: ids, sizes, a key of all turns before, and whether more follow."""
    seg = F.floor((F.col("depth") - 1) / width).cast("int").alias("seg")
    pieces = turns.groupBy("conv_id", seg).agg(
        F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "size"))).alias("t"),
        F.bit_xor(F.xxhash64("depth", "k1", "k2")).alias("x1"),
        F.bit_xor(F.xxhash64("k2", "k1", "depth")).alias("x2"),
    )
    pieces = convs.where("length = 0").select("conv_id", F.lit(0).alias("seg"), F.lit(0).alias("length")).unionByName(
        pieces, allowMissingColumns=True
    )
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    follows = Window.partitionBy("conv_id").orderBy("seg")
    ids = F.transform("t", lambda x: F.concat(F.lpad(F.hex(x["k1"]), 16, "0"), F.lpad(F.hex(x["k2"]), 16, "0")))
    return pieces.select(
        "conv_id",
        "seg",
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("p1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("p2"),
        F.unhex(F.coalesce(F.array_join(ids, ""), F.lit(""))).alias("ids"),
        F.coalesce(F.transform("t", lambda x: x["size"]), F.expr("array()").cast("array<bigint>")).alias("sizes"),
        F.lead("seg").over(follows).isNotNull().alias("more"),
    )


def _shared(a: bytes, b: bytes) -> int:
    """How many turn ids two sequences share from the start."""
    n = min(len(a), len(b)) // ID_BYTES
    x, y = (np.frombuffer(raw, np.uint8)[: n * ID_BYTES].reshape(n, ID_BYTES) for raw in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0] if len(differ) else n)


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many nodes, the entry included, the first row of a block shares with the row before."""
    for batch in batches:
        shared = [1 + _shared(r.ids, r.ids_before) if r.same_entry else 0 for r in batch.itertuples()]
        yield pd.DataFrame({"block": batch["block"].astype("int32"), "shared": np.array(shared, np.int64)})


def _block_borders(rows: DataFrame) -> dict[int, int]:
    """For each block, how many nodes its first row shares with the last row before; one number a block."""
    row = F.struct("p1", "p2", "ids", "more", "conv_id")
    ends = rows.groupBy(F.col("_block").alias("block")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    # one row a block; blocks are as many as shuffle partitions
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("block")))
    same = (F.col("first.p1") == F.col("before.p1")) & (F.col("first.p2") == F.col("before.p2"))
    lag = ends.select(
        "block",
        F.coalesce(same, F.lit(False)).alias("same_entry"),
        F.col("first.ids").alias("ids"),
        F.col("before.ids").alias("ids_before"),
    )
    return {r["block"]: r["shared"] for r in lag.mapInPandas(_borders, "block int, shared long").collect()}


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices of local turn numbers and of sizes, and row lengths; numbers keep the order of the ids."""
    lengths = np.array([len(x) for x in rows["sizes"]], np.int64)
    width = int(lengths.max())
    inside = np.arange(width) < lengths[:, None]
    ids = np.full((len(rows), width), -1, np.int32)
    sizes = np.zeros((len(rows), width), np.int64)
    raw = np.frombuffer(b"".join(rows["ids"]), ">u8").reshape(-1, 2)
    if len(raw):
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        new = np.ones(len(raw), bool)
        new[1:] = (raw[order][1:] != raw[order][:-1]).any(axis=1)
        number = np.empty(len(raw), np.int32)
        number[order] = np.cumsum(new) - 1
        ids[inside] = number
        sizes[inside] = np.concatenate(list(rows["sizes"]))
    return ids, sizes, lengths


def _nodes(rows: pd.DataFrame, block: int, start: int, shared_before: int, shared_after: int) -> pd.DataFrame:
    """The nodes of one block; those that cross its borders carry keys and the ids that end there."""
    ids, sizes, lengths = _matrix(rows)
    n, width = ids.shape
    convs, more = rows["conv_id"].to_numpy(np.int64), rows["more"].to_numpy(bool)
    entry = rows[["p1", "p2"]].to_numpy(np.int64)
    order = np.lexsort((convs, more, *ids.T[::-1], entry[:, 1], entry[:, 0]))
    ids, sizes, lengths, convs, more, entry = (x[order] for x in (ids, sizes, lengths, convs, more, entry))
    raw = rows["ids"].to_numpy()[order]
    extra = {c: rows[c].to_numpy(np.int64)[order] for c in ("add_children", "add_leaves", "add_saved")}

    # column 0 is the node that all rows of an entry start from
    change = np.ones((n, width + 1), bool)
    change[1:, 0] = (entry[1:] != entry[:-1]).any(axis=1)
    change[1:, 1:] = ids[1:] != ids[:-1]
    change = np.logical_or.accumulate(change, axis=1)
    valid = np.arange(width + 1) <= lengths[:, None]
    born = change & valid
    born[0, :shared_before] = False
    sizes = np.concatenate((np.zeros((n, 1), np.int64), sizes), axis=1)
    rest = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    saved = rest(sizes) - rest(sizes * born) + extra["add_saved"][:, None]
    goes_on = np.empty(n, bool)
    goes_on[:-1] = ~change[np.arange(1, n), lengths[:-1]]
    goes_on[-1] = shared_after > lengths[-1]
    leaves = (~more & ~goes_on) + extra["add_leaves"]

    found, above = [], None
    for depth in range(width + 1):
        at = np.flatnonzero(valid[:, depth])
        starts = np.flatnonzero(change[at, depth])
        children = born[at, depth + 1].astype(np.int64) if depth < width else np.zeros(len(at), np.int64)
        children += np.where(lengths[at] == depth, extra["add_children"][at], 0)
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
        first, last = at[starts], at[np.append(starts[1:], len(at)) - 1]
        least = np.minimum.reduceat(convs[at], starts)
        ending = (lengths[at] == depth) & ~more[at]
        least_more = np.minimum.reduceat(np.where((lengths[at] == depth) & more[at], convs[at], _NONE), starts)
        n_ends = add(ending.astype(np.int64))
        crossing = ((first == 0) & (depth < shared_before)) | ((last == n - 1) & (depth < shared_after))
        # rows that end at a node stand before those that go on
        ends = [",".join(map(str, convs[s : s + k])) for s, k in zip(first, n_ends)]
        keys = [
            hashlib.blake2b(entry[s].tobytes() + raw[s][: depth * ID_BYTES], digest_size=16).digest() if c else None
            for s, c in zip(first, crossing)
        ]
        here = np.full(n, -1, np.int64)
        here[at] = np.cumsum(change[at, depth]) - 1
        up = above["node"][first] if above else np.zeros(len(first), np.int64)
        found.append(
            pd.DataFrame(
                {
                    "depth": start + depth,
                    "conv_id": least,
                    "parent_conv_id": above["least"][up] if above else np.full(len(first), -1),
                    "n_convs": np.diff(np.append(starts, len(at))),
                    "n_children": add(children),
                    "n_leaves": add(leaves[at]),
                    "saved_tokens": add(saved[at, depth]),
                    "least_more": pd.Series(least_more).astype("Int64").mask(least_more == _NONE),
                    "ends_sha256": [
                        None if c else hashlib.sha256(e.encode()).hexdigest() if e else _EMPTY_SHA for e, c in zip(ends, crossing)
                    ],
                    "key": keys,
                    "parent_key": [above["keys"][i] for i in up] if above else None,
                    "block": block,
                    "ends": [e if c else None for e, c in zip(ends, crossing)],
                }
            )
        )
        above = {"node": here, "least": least, "keys": keys}
    out = pd.concat(found, ignore_index=True)
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64").mask(out["depth"] == start)
    return out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of what ends at a key, block after block; the rows come sorted and are held one at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch["key"], batch["ends"]):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pd.DataFrame(done, columns=["key", "digest"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "digest"])


def _recombined(crossing: DataFrame) -> DataFrame:
    """Nodes that crossed borders, added up; ends are digested in the order of the blocks."""
    ends = crossing.where("ends <> ''").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
    digests = ends.mapInPandas(_digests, "key binary, digest string")
    summed = crossing.groupBy("key").agg(
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("least_more").alias("least_more"),
        F.first("parent_key", ignorenulls=True).alias("parent_key"),
    )
    return summed.join(digests, "key", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.lit(_EMPTY_SHA))
    ).drop("digest")


def _segment_nodes(rows: DataFrame, start: int) -> DataFrame:
    """Nodes below ``start`` turns, with the entry nodes themselves as depth ``start``."""
    rows = range_blocks(rows, ["p1", "p2", "ids", "more", "conv_id"])
    shared = _block_borders(rows)
    following = dict(zip(sorted(shared), sorted(shared)[1:]))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        after = shared.get(following.get(block), 0)
        return _nodes(pdf, block, start, shared[block], after)

    # a block is one range partition of conversations, WIDTH turns of each at most
    nodes = cut_lineage(rows.groupBy("_block").applyInPandas(work, _NODE), "nodes")
    inside = nodes.where("key is null").drop("key", "block", "ends")
    crossing = cut_lineage(_recombined(nodes.where("key is not null")), "crossing")
    found = inside.unionByName(crossing.drop("key"), allowMissingColumns=True)
    parents = crossing.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    joined = checked_join(found, parents, ["parent_key"], "left", salt=["conv_id"])
    return joined.withColumn("parent_conv_id", F.coalesce("_above", "parent_conv_id")).drop("_above", "parent_key")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); see ``rebuilt``
    for what a conversation is. Turns go by ``turn``, null first, equal ones in the order of a hash of role and
    text; null role and text are empty, rows without conv_id go, repeated rows are turns
    of their own. Extra columns are ignored; without conversations there is no
    root and no row. Equal turns are told by 128 hashed bits.
    """
    turns, convs = rebuilt(numbered_turns(conversations))
    pieces, found = cut_measured(segments(turns, convs, width), "segments", deepest=F.max("seg"))
    if found["deepest"] is None:
        return conversations.sparkSession.createDataFrame([], _NODE).select(*_columns())
    result, extras = None, None
    for seg in range(found["deepest"], -1, -1):
        rows = pieces.where(F.col("seg") == seg)
        added = ["add_children", "add_leaves", "add_saved"]
        if extras is None:
            rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in added])
        else:
            rows = rows.join(extras, "conv_id", "left").fillna(0, added)
        nodes = cut_lineage(_segment_nodes(rows, seg * width), "trie")
        if result is not None:
            # first nodes of the matrices below know the smallest member that goes on; here are all members
            above = nodes.where("least_more is not null").select(
                F.col("least_more").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_above")
            )
            result = checked_join(result, above, ["parent_conv_id", "depth"], "left", salt=["conv_id"])
            result = result.withColumn("parent_conv_id", F.coalesce("_above", "parent_conv_id")).drop("_above")
        entry = F.col("depth") == seg * width
        # what hangs below a node is added to the row of its smallest member
        extras = nodes.where(entry).select(
            "conv_id",
            F.col("n_children").alias("add_children"),
            F.col("n_leaves").alias("add_leaves"),
            F.col("saved_tokens").alias("add_saved"),
        )
        own = nodes if seg == 0 else nodes.where(~entry)
        result = own if result is None else result.unionByName(own)
    return result.select(*_columns())


def _columns() -> list[str]:
    return ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
