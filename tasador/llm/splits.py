"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str | Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; null ids are held out too."""
    ids = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(ids.cast("string")) % folds == 0, F.lit(True))


def bounded_sample(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id, so that repartitioning changes nothing."""
    total = rows.count()
    if total <= most:
        return rows
    share = int(most / total * 1_000_000)
    return rows.where(F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), 1_000_000) < share)
