"""Data tables behind the comparison charts, for all groups at once.

Every function takes ``by`` (group columns, none for the whole table). Groups
are summarised by partial aggregates first; rows only ever meet a table of
group statistics, never each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasador.plans.blocks import positions
from tasador.plans.joins import checked_join, sized_join
from tasador.plans.lineage import cut_lineage, cut_measured
from tasador.plans.quantiles import exact_quantiles

STRETCH = 10_000
BOX = math.sqrt(2) / 2  # bandwidths; a value is within a quarter of the unit of the expansion
TERMS = 17
REACH = 8.5  # bandwidths
_ALL = "_all"


def _grouped(df: DataFrame, col: str, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group columns and the value as ``x``, without rows that lack any of them."""
    rows = df.select(*by, F.lit(0).alias(_ALL), F.col(col).cast("double").alias("x"))
    return rows.dropna(subset=["x", *by]), [*by, _ALL]


def axis_limits(
    df: DataFrame, col: str, by: Sequence[str] = (), below: float = 0.0, above: float = 0.0
) -> DataFrame:
    """Smallest and largest value, widened by a share of each."""
    rows, key = _grouped(df, col, by)
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        (F.min("x") * (1 - below)).alias("axis_lo"),
        (F.max("x") * (1 + above)).alias("axis_hi"),
    ).drop(_ALL)


def quantile_limits(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    probs: tuple[float, float] = (0.02, 0.98),
    margin: float = 0.05,
) -> DataFrame:
    """Band of the middle values, widened on both sides by a share of its width."""
    q = exact_quantiles(df, col, probs, by)
    lo, hi = F.col("q")[0], F.col("q")[1]
    return q.select(
        *by,
        lo.alias("q_lo"),
        hi.alias("q_hi"),
        (lo - (hi - lo) * margin).alias("axis_lo"),
        (hi + (hi - lo) * margin).alias("axis_hi"),
    )


def value_share(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of each value within its group; missing values do not count."""
    counts = df.dropna(subset=[col, *by]).groupBy(*by, col).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.withColumn(_ALL, F.lit(0)), "counts")
    totals = counts.groupBy(*by, _ALL).agg(F.sum("n").alias("_total"))
    shares = checked_join(counts, totals, [*by, _ALL], salt=[col])
    return shares.withColumn("pct", F.col("n") * 100.0 / F.col("_total")).drop("_total", _ALL)


def rank_values(shares: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``: the place of each value by falling count, ties by value, from 1 in each group."""
    ranked = positions(shares.withColumn("_less", -F.col("n")), by, ["_less", col], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_less")


def _with_range(rows: DataFrame, key: list[str]) -> DataFrame:
    """Group size and value range; a single value gets a range of one around it."""
    span = rows.groupBy(*key).agg(
        F.count("*").alias("total"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi")
    )
    flat = F.col("x_lo") == F.col("x_hi")
    return span.withColumns(
        {
            "lo": F.when(flat, F.col("x_lo") - 0.5).otherwise(F.col("x_lo")),
            "hi": F.when(flat, F.col("x_hi") + 0.5).otherwise(F.col("x_hi")),
        }
    )


def _edge(i: Column, bins: int) -> Column:
    return F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins)


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., bin, lo, hi, n)``: equal-width bins, the last one closed; empty bins count 0."""
    rows, key = _grouped(df, col, by)
    rows = cut_lineage(rows, "values")
    spans, found = cut_measured(
        _with_range(rows, key).select(*key, "lo", "hi"), "ranges", rows=F.count(F.lit(1))
    )
    guess = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    guess = F.least(guess, F.lit(bins - 1)).cast("int")
    # the division may land a value next to an edge on its wrong side
    bin_no = (
        F.when(F.col("x") < _edge(F.col("_g"), bins), F.col("_g") - 1)
        .when((F.col("x") >= _edge(F.col("_g") + 1, bins)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    counts = (
        sized_join(rows, spans, found, key, salt=["x"])
        .withColumn("_g", guess)
        .withColumn("bin", bin_no)
        .groupBy(*key, "bin")
        .agg(F.count("*").alias("n"))
    )
    every_bin = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        every_bin.join(counts, [*key, "bin"], "left")
        .select(
            *by,
            "bin",
            _edge(F.col("bin"), bins).alias("lo"),
            _edge(F.col("bin") + 1, bins).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def int_histogram(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., value, n)``: one bin per whole number from least to greatest, gaps count 0.

    The numbers are made in stretches of ``STRETCH`` and these in stretches again, so a far-off
    value makes many rows but no long array.
    """
    rows, key = _grouped(df, col, by)
    counts = rows.groupBy(*key, F.floor("x").alias("value")).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "counts")
    span = counts.groupBy(*key).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    first, last = F.floor(F.col("a") / STRETCH), F.floor(F.col("b") / STRETCH)
    far = F.explode(F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH)))
    span = span.select(*key, "a", "b", first.alias("first"), last.alias("last"), far.alias("far"))
    near = F.sequence(
        F.greatest("first", F.col("far") * STRETCH), F.least("last", F.col("far") * STRETCH + (STRETCH - 1))
    )
    part = span.select(*key, "a", "b", F.explode(near).alias("part"))
    start, end = F.col("part") * STRETCH, F.col("part") * STRETCH + (STRETCH - 1)
    every = part.select(*key, F.explode(F.sequence(F.greatest("a", start), F.least("b", end))).alias("value"))
    return (
        every.join(counts, [*key, "value"], "left")
        .select(*by, "value", F.coalesce("n", F.lit(0)).alias("n"))
    )


def kde(
    df: DataFrame, col: str, by: Sequence[str] = (), grid: int = 200, bins: int = 30
) -> DataFrame:
    """Gaussian density over ``grid`` points from least to greatest value of each group.

    Bandwidth is Scott's rule, ``n^(-1/5)`` sample standard deviations. ``curve``
    is the density in counts per histogram bin, as drawn over a histogram. Groups without
    spread have no density and no rows.

    A fast Gauss transform: values fall into boxes of ``BOX`` bandwidths, a box keeps
    ``TERMS`` moments about its centre, and a point adds up the Hermite expansions of the boxes
    within ``REACH``. Rows to shuffle are boxes, whatever the grid. The sum over the kernel of ``n`` values is
    off by less than ``n * 1e-13``: an expansion to p terms of values within r of the centre (in units of
    the root of 2 times the bandwidth) by ``(r * sqrt 2)^p / (sqrt(p!) * (1 - r * sqrt 2))``, what
    lies out of reach by ``exp(-REACH^2 / 2)`` a value.
    """
    rows, key = _grouped(df, col, by)
    rows = cut_lineage(rows, "values")
    means = rows.groupBy(*key).agg(F.avg("x").alias("mean"))
    x = F.col("x")
    spans = (
        checked_join(rows, means, key, salt=["x"])
        .groupBy(*key)
        .agg(
            F.count("*").alias("total"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.sqrt(F.try_divide(F.sum(F.pow(x - F.col("mean"), 2)), F.count("*") - 1)).alias("sd"),
        )
        .where(F.col("sd") > 0)
        .withColumn("h", F.col("sd") * F.pow(F.col("total"), F.lit(-0.2)))
        .drop("sd")
    )
    spans, found = cut_measured(spans, "spans", rows=F.count("*"))
    side = F.col("h") * BOX
    centre = F.col("lo") + (F.col("_box") + 0.5) * side
    t = (x - centre) / (F.col("h") * math.sqrt(2))
    boxes = (
        sized_join(rows, spans, found, key, salt=["x"])
        .withColumn("_box", F.floor((x - F.col("lo")) / side))
        .withColumn("_t", t)
        .groupBy(*key, "_box")
        .agg(
            F.array(*[F.sum(F.pow("_t", F.lit(k)) / math.factorial(k)) for k in range(TERMS)]).alias("_moments"),
            *[F.first(c).alias(c) for c in ("total", "lo", "hi", "h")],
        )
    )
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    near = lambda sign: (centre + sign * F.col("h") * REACH - F.col("lo")) / step
    first = F.greatest(F.ceil(near(-1)), F.lit(0)).cast("int")
    last = F.least(F.floor(near(1)), F.lit(grid - 1)).cast("int")
    # points are fewer than boxes where values lie far apart: a box may reach none
    met = boxes.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    at = F.col("lo") + F.col("point") * step
    sums = (
        met.withColumn("_s", (at - centre) / (F.col("h") * math.sqrt(2)))
        .withColumn("_g", F.exp(-F.col("_s") * F.col("_s")))
        .withColumn("_part", _expansion())
        .groupBy(*key, "point")
        .agg(F.sum("_part").alias("_sum"))
    )
    every = spans.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    sums = every.join(sums, [*key, "point"], "left")
    density = F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(0.0)) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    width = (F.col("hi") - F.col("lo")) / bins
    return sums.select(
        *by,
        "point",
        at.alias("x"),
        density.alias("density"),
        (density * F.col("total") * width).alias("curve"),
    )


def _expansion() -> Column:
    """Sum of moments times Hermite functions at ``_s``; ``_g`` is the first of them."""
    start = F.struct(
        F.lit(0.0).alias("before"), F.col("_g").alias("now"), (F.get("_moments", 0) * F.col("_g")).alias("sum")
    )

    def term(acc: Column, k: Column) -> Column:
        following = 2 * F.col("_s") * acc["now"] - 2 * (k - 1) * acc["before"]
        return F.struct(
            acc["now"].alias("before"),
            following.alias("now"),
            (acc["sum"] + F.get("_moments", k) * following).alias("sum"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, term, lambda acc: acc["sum"])


def _fences(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    q = F.col("q")
    reach = 1.5 * (q[2] - q[0])
    return exact_quantiles(df, col, (0.25, 0.5, 0.75), by).select(
        *by,
        F.lit(0).alias(_ALL),
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        (q[0] - reach).alias("fence_lo"),
        (q[2] + reach).alias("fence_hi"),
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 box lengths) and outlier counts."""
    rows, key = _grouped(df, col, by)
    rows = cut_lineage(rows, "values")
    box = ["q1", "median", "q3"]
    x = F.col("x")
    inside = x.between(F.col("fence_lo"), F.col("fence_hi"))
    joined = checked_join(rows, _fences(rows, "x", by), key, salt=["x"])
    stats = joined.groupBy(*key).agg(
        F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in box],
        F.min(F.when(inside, x)).alias("_lo"),
        F.max(F.when(inside, x)).alias("_hi"),
        F.count_if(~inside).alias("outliers"),
    )
    return stats.select(
        *by,
        "n",
        *box,
        # a whisker never ends inside the box
        F.least("_lo", "q1").alias("whisker_lo"),
        F.greatest("_hi", "q3").alias("whisker_hi"),
        "outliers",
    )


def box_outliers(df: DataFrame, col: str, by: Sequence[str] = (), keep: Sequence[str] = ("id",)) -> DataFrame:
    """The rows beyond the whiskers."""
    rows = df.dropna(subset=[col, *by]).select(*dict.fromkeys([*keep, *by, col])).withColumn(_ALL, F.lit(0))
    rows = cut_lineage(rows, "values")
    fences = _fences(rows, col, by)
    joined = checked_join(rows, fences, [*by, _ALL], salt=list(keep))
    x = F.col(col).cast("double")
    return joined.where(~x.between(F.col("fence_lo"), F.col("fence_hi"))).select(*keep, *by, col)


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` over ``x``."""
    rows = df.dropna(subset=[x, y, *by])
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def compare_to_peers(
    subjects: DataFrame, listings: DataFrame, on: Sequence[str], col: str
) -> DataFrame:
    """Each subject next to the figures of its peers (same ``on``, itself included).

    Peers are summarised once per group and joined as one row; ``axis_lo`` and
    ``axis_hi`` leave a tenth of room and include the subject.
    """
    rows, _ = _grouped(listings, col, on)
    peers = rows.groupBy(*on).agg(
        F.count("*").alias("peers"),
        F.avg("x").alias("peer_mean"),
        F.min("x").alias("peer_min"),
        F.max("x").alias("peer_max"),
    )
    value = F.col(col).cast("double")
    return checked_join(subjects, peers, list(on)).withColumns(
        {
            "vs_mean_pct": F.try_divide((value - F.col("peer_mean")) * 100.0, F.col("peer_mean")),
            "axis_lo": F.col("peer_min") * 0.9,
            "axis_hi": F.greatest("peer_max", value) * 1.1,
        }
    )


def mark_share(shares: DataFrame, subjects: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Shares of each subject's group with the subject's own value marked."""
    own = subjects.select(F.col("id").alias("subject"), *by, F.col(col).alias("_own"))
    return checked_join(own, shares, list(by), salt=["subject"]).withColumn(
        "highlight", F.coalesce(F.col(col) == F.col("_own"), F.lit(False))
    ).drop("_own")
