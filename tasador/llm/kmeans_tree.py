"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on ``SAMPLE_ROWS`` vectors at most, chosen by a hash of the
id; every vector is then put into its leaf. A query keeps open branches in a
priority queue by distance to their centre and visits leaves in that order. How
many leaves are visited is calibrated: the number is widened until the sampled
queries find ``TARGET`` of their true neighbours in the sample.

Queries and vectors meet by (leaf, block): a leaf is split into blocks of about
``BLOCK_ROWS`` vectors, and many queries of one leaf into blocks as well, so no
group grows with the data. Distances are exact, in double precision.

Rows: vectors that are null, empty, zero or hold null or non-finite components,
or have another length than most, take no part; repeated rows count once; equal
distances go to the smaller id; with fewer candidates all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasador.llm.splits import bounded_sample
from tasador.llm.vectors import nearest_copies, of_one_width, stacked, usable
from tasador.plans.lineage import cut_lineage

SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 64
TARGET = 0.97
CALIBRATION_QUERIES = 200
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to rounding."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


@dataclass
class Tree:
    """Nodes by number; a node without children is a leaf and has a leaf number."""

    centres: list[np.ndarray | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def _add(self) -> int:
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    @classmethod
    def fit(cls, points: np.ndarray, seed: int = 5) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        waiting = [(tree._add(), np.arange(len(points)))]
        while waiting:
            node, own = waiting.pop()
            groups = []
            if len(own) > LEAF_ROWS:
                x = points[own]
                centres = np.unique(x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)], axis=0)
                for _ in range(8):
                    near = squared(x, centres).argmin(1)
                    centres = np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
                near = squared(x, centres).argmin(1)
                groups = [(centres[i], own[near == i]) for i in range(len(centres)) if (near == i).any()]
            if len(groups) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            tree.centres[node] = np.stack([c for c, _ in groups])
            for _, members in groups:
                child = tree._add()
                tree.children[node].append(child)
                waiting.append((child, members))
        return tree

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point, going to the nearest centre at each level."""
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, own = waiting.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            near = squared(points[own], self.centres[node]).argmin(1)
            waiting += [(child, own[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        found: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                gaps = ((self.centres[node] - query) ** 2).sum(1)
                best = int(gaps.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(gaps[i]), child))
                node = self.children[node][best]
            found.append(self.leaf[node])
        return found

    def calibrate(self, points: np.ndarray, k: int, target: float, queries: int = CALIBRATION_QUERIES) -> int:
        """The fewest leaves by which the share ``target`` of the true neighbours is found."""
        if len(points) < 2:
            return 1
        own = self.assign(points)
        asked = np.random.default_rng(11).choice(len(points), min(queries, len(points)), replace=False)
        gaps = squared(points[asked], points)
        gaps[np.arange(len(asked)), asked] = np.inf
        k = min(k, len(points) - 1)
        true = np.argpartition(gaps, k - 1, axis=1)[:, :k]
        found_at = np.zeros(self.leaves + 1, np.int64)
        for i, query in enumerate(asked):
            place = np.zeros(self.leaves, np.int64)
            order = self.visit(points[query], self.leaves)
            place[order] = np.arange(1, len(order) + 1)
            found_at += np.bincount(place[own[true[i]]], minlength=self.leaves + 1)
        return max(1, int(np.searchsorted(np.cumsum(found_at) / found_at.sum(), target)))


def fit(rows: DataFrame, k: int, target: float = TARGET, sample_rows: int = SAMPLE_ROWS) -> tuple[Tree, int]:
    """The tree and the calibrated number of leaves to visit."""
    sample = bounded_sample(rows, "vec_id", sample_rows).toPandas().sort_values("vec_id")
    points = stacked(sample["vector"])
    tree = Tree.fit(points)
    return tree, tree.calibrate(points, k, target)


def _search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block."""
    q, x = stacked(queries["vector"]), stacked(rows["vector"])
    query_ids, ids = queries["query_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    rough = squared(q, x)
    rough[query_ids[:, None] == ids[None, :]] = np.inf
    bound = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    slack = 1e-9 * (1 + (q**2).sum(1) + (x**2).sum(1).max())
    at, of = np.nonzero((rough <= (bound + slack)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((q[at] - x[of]) ** 2).sum(1))
    found = pd.DataFrame({"query_id": query_ids[at], "vec_id": ids[of], "score": exact})
    found = found.sort_values(["query_id", "score", "vec_id"])
    return found[found.groupby("query_id").cumcount() < k]


def nearest(
    embeddings: DataFrame, k: int = 10, every: int = 100, target: float = TARGET, vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id ``every`` divides."""
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=False))
    rows = of_one_width(rows)
    tree, visits = fit(rows, k, target)
    shared = spark.sparkContext.broadcast((tree, visits))

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value[0].assign(stacked(batch["vector"])).astype(np.int32))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, count = shared.value
        for batch in batches:
            leaves = [np.array(found.visit(v, count), np.int32) for v in stacked(batch["vector"])]
            yield batch.assign(leaves=leaves)

    indexed = cut_lineage(
        nearest_copies(rows, k + 1).mapInPandas(to_leaf, "vec_id long, vector array<double>, leaf int"), "leaves"
    )
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = cut_lineage(
        queries.withColumnRenamed("vec_id", "query_id")
        .mapInPandas(to_visits, "query_id long, vector array<double>, leaves array<int>")
        .withColumn("leaf", F.explode("leaves"))
        .drop("leaves"),
        "visits",
    )

    # as many rows as the tree has leaves, which SAMPLE_ROWS bounds
    blocks = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("rs"))
    query_blocks = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qs"))
    split = F.broadcast(blocks.join(query_blocks, "leaf"))

    def block(column: str, count: str):
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def copies(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = asked.join(split, "leaf").withColumn("q", block("query_id", "qs")).withColumn("r", copies("rs"))
    right = indexed.join(split, "leaf").withColumn("r", block("vec_id", "rs")).withColumn("q", copies("qs"))

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _search_block(queries, rows, k)

    found = (
        left.select("leaf", "r", "q", "query_id", "vector")
        .groupBy("leaf", "r", "q")
        .cogroup(right.select("leaf", "r", "q", "vec_id", "vector").groupBy("leaf", "r", "q"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
