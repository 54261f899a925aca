"""Exact top-k inner products of whole-number vectors by a vector-approximation file.

Every component is replaced by the number of its cell; the cells of a
dimension are cut at quantiles of a bounded sample, and their true least and
greatest values are taken from all rows. The cells alone give an upper and a
lower bound of each inner product.

1. Query blocks scan blocks of cells. Per query and block only rows remain whose
   upper bound reaches the k-th best lower bound there, then, per query, over
   all blocks.
2. The exact vectors are read in the order of their upper bounds, in rounds: first the k
   most promising of each query, then those rows among the next whose upper bound still
   reaches the k-th exact score found so far, until no bound does. No other row can
   be among the first k.

Queries are the rows whose id is divisible by ``every``; each block pair is a
group of bounded size. Sums are exact whole numbers.

Rows: vectors that are null, empty or hold null or non-finite components, or
have another length than most, take no part, nor do those with a component so large
(above the root of 2^62 by the length, after scaling) that a score might not fit a long; zero vectors do; repeated rows
count once; equal scores go to the smaller id; with fewer candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasador.llm.splits import bounded_sample
from tasador.llm.vectors import nearest_copies, of_one_width, stacked, usable
from tasador.plans.lineage import cut_lineage, cut_measured

SCALE = 64
CELLS = 256  # as many as a byte tells apart
ROUND = 4  # each round reads so many times the vectors of those before
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 1024


@dataclass
class Cells:
    """Cuts between cells, and the least and greatest value in every cell, per dimension."""

    cuts: list[np.ndarray]
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers, one byte each."""
        return np.stack([np.searchsorted(c, x[:, d], "right") for d, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


def fit_cells(rows: DataFrame, cells: int = CELLS) -> Cells:
    """Quantile cuts from a bounded sample; bounds of the cells from all rows."""
    sample = stacked(bounded_sample(rows, "vec_id", SAMPLE_ROWS).toPandas()["vector"], np.int64)
    width = sample.shape[1] if len(sample) else 0
    cuts = [np.unique(np.quantile(sample[:, d], np.arange(1, cells) / cells, method="higher")) for d in range(width)]
    made = Cells([c.astype(np.int64) for c in cuts])

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.full((width, cells), np.iinfo(np.int64).max)
        high = np.full((width, cells), np.iinfo(np.int64).min)
        for batch in batches:
            if not len(batch):
                continue
            x = stacked(batch["vector"], np.int64)
            cell = made.of(x)
            for d in range(width):
                np.minimum.at(low[d], cell[:, d], x[:, d])
                np.maximum.at(high[d], cell[:, d], x[:, d])
        d, c = np.nonzero(low <= high)
        yield pd.DataFrame({"d": d, "c": c, "low": low[d, c], "high": high[d, c]})

    found = (
        rows.mapInPandas(extremes, "d int, c int, low long, high long")
        .groupBy("d", "c")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .toPandas()  # width x cells at most
    )
    made.low, made.high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
    d, c = found["d"].to_numpy(int), found["c"].to_numpy(int)
    made.low[d, c], made.high[d, c] = found["low"], found["high"]
    return made


def _exact_type(*parts: np.ndarray) -> type:
    """The quickest number type in which sums of products of these are exact."""
    most = 1.0
    for part in parts:
        most *= float(np.abs(part.astype(float)).max(initial=1))
    most *= parts[0].shape[-1]
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def bounds(q: np.ndarray, cell: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of queries with rows given by their cells."""
    kind = _exact_type(q, np.stack([cells.low, cells.high]).transpose(0, 2, 1))
    dims = np.arange(cell.shape[1])
    low, high = cells.low[dims, cell].astype(kind), cells.high[dims, cell].astype(kind)
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _scan(queries: pd.DataFrame, rows: pd.DataFrame, cells: Cells, k: int) -> pd.DataFrame:
    """(query, row, lower, upper) that the k-th best lower bound of the block does not rule out."""
    q = stacked(queries["vector"], np.int64)
    cell = np.stack([np.frombuffer(c, np.uint8) for c in rows["cell"]])
    query_ids, ids = queries["query_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    low, high = bounds(q, cell, cells)
    own = query_ids[:, None] == ids[None, :]
    least = np.iinfo(np.int64).min if low.dtype == np.int64 else -np.inf
    low[own] = least
    n = min(k, low.shape[1])
    kth = -np.partition(-low, n - 1, axis=1)[:, n - 1]
    at, of = np.nonzero((high >= kth[:, None]) & ~own)
    return pd.DataFrame(
        {"query_id": query_ids[at], "vec_id": ids[of], "low": low[at, of].astype(np.int64), "high": high[at, of].astype(np.int64)}
    )


def top_products(
    embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x)."""
    spark = embeddings.sparkSession
    raw = F.col(vector_col).cast("array<double>")
    rows = embeddings.where(usable(raw, zero=True)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(raw, lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"),
    )
    # floor() holds what is too large at the largest long, which is above the bound as well
    largest = F.sqrt(F.lit(2.0**62) / F.size("vector"))
    rows = rows.where(F.forall("vector", lambda v: (v.cast("double") <= largest) & (v.cast("double") >= -largest)))
    rows = of_one_width(rows.where(F.col("vec_id").isNotNull()))
    cells = spark.sparkContext.broadcast(fit_cells(rows))

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell = cells.value.of(stacked(batch["vector"], np.int64))
                yield batch.assign(cell=[c.tobytes() for c in cell])

    # the k + 1 smallest ids of equal vectors: one of them may be the query's own
    kept = nearest_copies(rows, k + 1).mapInPandas(approximate, "vec_id long, vector array<long>, cell binary")
    kept, found = cut_measured(kept, "cells", n=F.count(F.lit(1)))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")
    queries, asked = cut_measured(queries, "queries", n=F.count(F.lit(1)))
    row_blocks = -(-(found["n"] or 0) // BLOCK_ROWS) or 1
    query_blocks = -(-(asked["n"] or 0) // BLOCK_QUERIES) or 1

    def block(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every_block(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("q", block("query_id", query_blocks)).withColumn("r", every_block(row_blocks))
    right = kept.select("vec_id", "cell", block("vec_id", row_blocks).alias("r"), every_block(query_blocks).alias("q"))

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "low": [], "high": []})
        return _scan(a, b, cells.value, k)

    bounded = (
        left.groupBy("r", "q")
        .cogroup(right.groupBy("r", "q"))
        .applyInPandas(scan, "query_id long, vec_id long, low long, high long")
    )
    bounded = cut_lineage(bounded, "bounds")
    by_low = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    kth_low = bounded.withColumn("n", by_low).where(F.col("n") <= k).groupBy("query_id").agg(F.min("low").alias("least"))
    open_rows = bounded.join(kth_low, "query_id").where(F.col("high") >= F.col("least")).drop("low", "least")

    by_high = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id"))
    open_rows = cut_lineage(open_rows.withColumn("turn", by_high), "open")

    def exact(pairs: DataFrame) -> DataFrame:
        """Exact scores of (query, row) pairs."""
        product = F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        with_row = pairs.join(kept.select("vec_id", F.col("vector").alias("b")), "vec_id")
        both = with_row.join(queries.select("query_id", F.col("vector").alias("a")), "query_id")
        return both.select("query_id", "vec_id", product.alias("score"))

    scored = cut_lineage(exact(open_rows.where(F.col("turn") <= k).select("query_id", "vec_id")), "scores")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    upto = k
    while True:
        kth = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        kth = kth.groupBy("query_id").agg(F.min("score").alias("sure"))
        open_rows = open_rows.where(F.col("turn") > upto).join(kth, "query_id").where(F.col("high") >= F.col("sure"))
        open_rows, left = cut_measured(open_rows.drop("sure"), "open", n=F.count(F.lit(1)))
        if not left["n"]:
            break
        upto *= ROUND
        scored = cut_lineage(
            scored.unionByName(exact(open_rows.where(F.col("turn") <= upto).select("query_id", "vec_id"))), "scores"
        )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
