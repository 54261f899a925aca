"""Exact quantiles whose memory need does not grow with the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_measured

LEAF_ROWS = 200_000
BINS = 1024


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    leaf_rows: int = LEAF_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """``(by..., q)`` with ``q`` the linearly interpolated quantiles in order of ``probs``.

    Groups of at most ``leaf_rows`` rows use the built-in exact percentile. In
    larger ones each wanted rank is narrowed down by counting rows per value bin,
    which only ships bin counts, until few enough rows are left to sort.
    """
    by = list(by)
    rows = df.select(
        *[F.col(c) for c in by], F.lit(0).alias("_all"), F.col(value).cast("double").alias("_x")
    ).where(F.col("_x").isNotNull())
    key = [*by, "_all"]
    sizes, found = cut_measured(
        rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")),
        "group-sizes",
        largest=F.max("n"),
    )
    if (found["largest"] or 0) <= leaf_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return rows.groupBy(*key).agg(F.percentile("_x", wanted).alias("q")).drop("_all")
    return _by_narrowing(rows, key, sizes, probs, leaf_rows, bins).drop("_all")


def _by_narrowing(rows, key, sizes, probs, leaf_rows, bins) -> DataFrame:
    cell = [*key, "lo", "hi"]
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    )
    exact_rank = F.col("w.p") * (F.col("n") - 1)
    # one row per order statistic: the lower and the upper neighbour of each quantile
    targets = (
        sizes.withColumn("w", wanted)
        .select(*cell, "n", F.col("w.i").alias("i"), exact_rank.alias("r"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("r"), F.ceil("r")))))
        .withColumn("below", F.lit(0).cast("long"))
    )
    open_cell = (F.col("n") > leaf_rows) & (F.col("lo") < F.col("hi"))
    while True:
        targets, found = cut_measured(targets, "ranks", pending=F.count_if(open_cell))
        if not found["pending"]:
            break
        pending = targets.where(open_cell)
        counted = _cell_rows(rows, pending, key).withColumn(
            "bin",
            F.least(
                F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
            ),
        )
        counted = counted.groupBy(*cell, "bin").agg(
            F.count("*").alias("c"), F.min("_x").alias("bin_lo"), F.max("_x").alias("bin_hi")
        )
        earlier = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        offset = F.col("rank") - F.col("below") - F.col("before")
        narrowed = (
            pending.join(counted, cell)
            .where((offset >= 0) & (offset < F.col("c")))
            .select(
                *key,
                F.col("bin_lo").alias("lo"),
                F.col("bin_hi").alias("hi"),
                F.col("c").alias("n"),
                "i",
                "r",
                "rank",
                (F.col("below") + F.col("before")).alias("below"),
            )
        )
        targets = targets.where(~open_cell).unionByName(narrowed)

    several = F.col("lo") < F.col("hi")
    sorted_cells = (
        _cell_rows(rows, targets.where(several), key)
        .groupBy(*cell)
        .agg(F.sort_array(F.collect_list("_x")).alias("xs"))
    )
    position = (F.col("rank") - F.col("below") + 1).cast("int")
    found = targets.join(sorted_cells, cell, "left").withColumn(
        "v", F.when(several, F.element_at("xs", position)).otherwise(F.col("lo"))
    )
    low, high = F.min("v"), F.max("v")
    between = F.max(F.ceil("r") - F.col("r")) * low + F.max(F.col("r") - F.floor("r")) * high
    quantile = found.groupBy(*key, "i").agg(F.when(low == high, low).otherwise(between).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return quantile.groupBy(*key).agg(F.transform(ordered, lambda s: s["v"]).alias("q"))


def _cell_rows(rows: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Rows that fall into a wanted cell; cells of a group never overlap."""
    cells = targets.select(*key, "lo", "hi").distinct()
    joined = checked_join(rows, cells, key, salt=["_x"])
    return joined.where(F.col("_x").between(F.col("lo"), F.col("hi")))
