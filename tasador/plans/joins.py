"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasador.plans.lineage import cut_measured

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20  # as Parquet, a few times that in memory
NULL_SPLITS = 1 << 20
ROWS_PER_SPLIT = 1_000_000


def checked_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Join rows with a derived table of narrow rows (group statistics, ids, cuts).

    ``small`` is materialised and measured: up to ``broadcast_rows`` rows and
    ``BROADCAST_BYTES`` it is broadcast, so ``big`` is not shuffled at all; beyond that
    the join is salted.
    """
    small, found = cut_measured(small, "lookup", rows=F.count(F.lit(1)))
    return sized_join(big, small, found, on, how, salt, broadcast_rows, rows_per_split)


def sized_join(
    big: DataFrame,
    small: DataFrame,
    found: Mapping[str, int],
    on: Sequence[str],
    how: str = "inner",
    salt: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """``checked_join`` with a table that has been materialised before: ``found`` has its ``rows`` and ``bytes``."""
    if found["rows"] <= broadcast_rows and found["bytes"] <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how, salt, broadcast_rows, rows_per_split)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Equi-join that splits hot keys of ``big`` and copies their rows of ``small``.

    Works for joins that keep or drop rows of ``big`` (inner, left, left_semi,
    left_anti). ``salt`` names columns that tell rows of a hot key apart. Keys
    that are not hot are neither split nor copied. Rows without a key meet
    nothing and are spread.
    """
    on = list(on)
    sizes, found = cut_measured(
        big.groupBy(*on).agg(F.count("*").alias("_rows")), "sizes", total=F.sum("_rows")
    )
    total = found["total"] or 0
    # at most total / limit keys can be hot, so the table below is never larger
    # than broadcast_rows
    limit = max(rows_per_split, -(-total // broadcast_rows))
    hot = sizes.where(F.col("_rows") > limit).select(
        *on, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_splits")
    )
    splits = F.coalesce("_splits", F.lit(1))
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    parts = F.when(keyless, F.lit(NULL_SPLITS)).otherwise(splits)
    salt_of_row = F.pmod(F.xxhash64(*(salt or big.columns)), parts).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn("_salt", salt_of_row).drop("_splits")
    right = (
        small.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
