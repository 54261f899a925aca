"""Tables of vectors: which rows take part, and equal vectors once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """Vectors with at least one component and only finite ones; zero vectors only if asked for."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(found if zero else found & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with equal ``vector``, those with the ``most`` smallest ids; repeated rows count once.

    Ties go to smaller ids, so no other copy can be among the first ``most - 1``
    of any query that leaves out one id. The rank is cut off before rows are
    shuffled, so a vector that a third of all rows share is no burden.
    """
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    return rows.dropDuplicates(["vec_id", "vector"]).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def stacked(series: pd.Series, kind: type = np.float64) -> np.ndarray:
    """Rows of equally long arrays as one matrix."""
    return np.stack([np.asarray(v, kind) for v in series]) if len(series) else np.zeros((0, 0), kind)


def of_one_width(rows: DataFrame) -> DataFrame:
    """Vectors of the commonest length (the shorter of equally common ones); others cannot be compared."""
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.where(F.size("vector") == (widths[0]["width"] if widths else 0))
