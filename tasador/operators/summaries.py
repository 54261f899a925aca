"""Chart figures per group that a daily batch is merged into, without reading older listings.

A summary row holds moments, a quantile sketch and the extremes of a group; another table holds counts
of fixed-width bins. Both merge: the summary of two batches together is the
merge of their summaries. Moments and bins come out as from one full pass, quantiles
within the sketch's rank error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasador.plans.lineage import cut_lineage
from tasador.sources.runs import log_entries, publish_version

SKETCH_K = 800  # a quantile's rank is off by less than 0.4 % of the group with 99 % probability
RANK_ERROR = 0.004


def summarise(df: DataFrame, x: str, y: str, by: Sequence[str], width: float) -> tuple[DataFrame, DataFrame]:
    """Moments of ``x`` and ``y`` with a sketch of ``y`` (one row a group), and counts of ``y`` in bins of ``width``.

    Rows without a value of ``y`` or a group are left out; ``x`` may be missing and
    enters the trend only where it is there.
    """
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.dropna(subset=["y", *by])
    both = lambda c: F.when(F.col("x").isNotNull(), c)
    summary = rows.groupBy(*by).agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        (F.var_pop("y") * F.count("y")).alias("m2"),
        F.min("y").alias("lo"),
        F.max("y").alias("hi"),
        F.count("x").alias("xy_n"),
        F.coalesce(F.avg("x"), F.lit(0.0)).alias("x_mean"),
        F.coalesce(F.avg(both(F.col("y"))), F.lit(0.0)).alias("xy_mean"),
        F.coalesce(F.var_pop("x") * F.count("x"), F.lit(0.0)).alias("x_m2"),
        F.coalesce(F.var_pop(both(F.col("y"))) * F.count("x"), F.lit(0.0)).alias("xy_m2"),
        F.coalesce(F.covar_pop("x", both(F.col("y"))) * F.count("x"), F.lit(0.0)).alias("cxy"),
        F.kll_sketch_agg_double("y", SKETCH_K).alias("sketch"),
    )
    bins = rows.groupBy(*by, F.floor(F.col("y") / width).alias("bin")).agg(F.count("*").alias("n"))
    return summary, bins


def merge(summaries: DataFrame, bins: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row a group from rows of several batches: counts added, moments about the common mean."""
    def pooled(mean: str, count: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(mean) * F.col(count)), F.sum(count)), F.lit(0.0))

    merged = summaries.groupBy(*by).agg(
        F.sum("n").alias("n"),
        pooled("mean", "n").alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2", "xy_n", "x_mean", "xy_mean", "x_m2", "xy_m2", "cxy")).alias("parts"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("xy_n").alias("xy_n"),
        pooled("x_mean", "xy_n").alias("x_mean"),
        pooled("xy_mean", "xy_n").alias("xy_mean"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"),
    )

    def total(spread: str, a: str, b: str, count: str) -> Column:
        """Within the batches, and between their means and the common ones."""
        return F.aggregate(
            "parts", F.lit(0.0), lambda acc, p: acc + p[spread] + p[count] * (p[a] - F.col(a)) * (p[b] - F.col(b))
        ).alias(spread)

    # as many parts as batches are merged at once
    merged = merged.select(
        *by,
        "n",
        "mean",
        total("m2", "mean", "mean", "n"),
        "lo",
        "hi",
        "xy_n",
        "x_mean",
        "xy_mean",
        total("x_m2", "x_mean", "x_mean", "xy_n"),
        total("xy_m2", "xy_mean", "xy_mean", "xy_n"),
        total("cxy", "x_mean", "xy_mean", "xy_n"),
        "sketch",
    )
    return merged, bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The summaries and bins published last; None before the first batch."""
    entries = log_entries(spark, path)
    if not entries:
        return None
    return _version(spark, path, entries[-1])


def _version(spark: SparkSession, path: str, entry: dict) -> tuple[DataFrame, DataFrame]:
    folder = f"{path}/_runs/{entry['folder']}"
    return spark.read.parquet(f"{folder}/summaries"), spark.read.parquet(f"{folder}/bins")


def merge_batch(batch: DataFrame, path: str, x: str, y: str, by: Sequence[str], width: float, label: str) -> bool:
    """Merge a batch into the summaries at ``path``; False if a batch of that ``label`` is in already.

    Reads the batch and the last summaries, a row a group and a row a bin. Writers that overtake
    each other merge again, so no batch is lost or counted twice.
    """
    spark, by = batch.sparkSession, list(by)
    summary, bins = summarise(batch, x, y, by, width)
    summary, bins = cut_lineage(summary, "summary"), cut_lineage(bins, "bins")

    def version(entries: list[dict], folder: str) -> bool:
        if any(e.get("run") == label for e in entries):
            return False
        new_summary, new_bins = summary, bins
        if entries:
            old_summary, old_bins = _version(spark, path, entries[-1])
            new_summary, new_bins = merge(old_summary.unionByName(summary), old_bins.unionByName(bins), by)
        new_summary.write.parquet(f"{folder}/summaries")
        new_bins.write.parquet(f"{folder}/bins")
        return True

    return publish_version(spark, path, version, label)


def quantile(summaries: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(by..., q)``: quantiles of ``y`` from the sketches, in the order of ``probs``."""
    values = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs])
    return summaries.select(*by, values.alias("q"))


def trend(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares line of ``y`` over ``x`` from the moments; null where ``x`` does not vary."""
    slope = F.try_divide("cxy", "x_m2")
    return summaries.select(
        *by,
        F.col("xy_n").alias("n"),
        slope.alias("slope"),
        (F.col("xy_mean") - slope * F.col("x_mean")).alias("intercept"),
        F.when(F.col("xy_m2") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("cxy") * F.col("cxy"), F.col("x_m2") * F.col("xy_m2"))).alias("r2"),
    )
