"""Ordered work over groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasador.plans.lineage import cut_lineage


def range_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Cut rows into consecutive blocks of the total order and number them.

    Blocks are range partitions, so a single huge group spreads over many of
    them; ``order`` must be unique per row for blocks to stay even. The numbers
    depend on sampled bounds, hence the rows are written once and read back.
    """
    count = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).withColumn("_block", F.spark_partition_id())
    return cut_lineage(ranged, "blocks")


def positions(
    df: DataFrame, owner: Sequence[str], order: Sequence[str], name: str = "position", blocks: int | None = None
) -> DataFrame:
    """Number the rows of each owner from 0 in ``order``, however many one owner has.

    Rows are counted inside range blocks; only one count per owner and block is
    windowed to find where a block starts.
    """
    owner, order = list(owner), list(order)
    rows = range_blocks(df, [*owner, *order], blocks)
    counts = rows.groupBy(*owner, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(owner or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*owner, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*owner, "_block").orderBy(*order)
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, [*owner, "_block"])
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).drop("_block", "_start", "_inside")
