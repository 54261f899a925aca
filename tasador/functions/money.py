"""Price arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 10_000  # estimates are given in steps of this many euros
DAMPING = 0.66  # part of the difference that is kept back


def price_per_area(price: Column, area: Column) -> Column:
    return F.try_divide(price.cast("double"), F.nullif(area.cast("double"), F.lit(0.0)))


def rounded_estimate(price: Column, diff: Column) -> Column:
    """Estimate to the nearest step, halves to the even step."""
    return (F.bround((price + diff) / STEP) * STEP).cast("long")


def with_price_interval(
    df: DataFrame, price: str = "Precio", diff: str = "Diferencia_Ponderada"
) -> DataFrame:
    """Add ``estimacion``, ``minimo``, ``maximo`` and the printed ``intervalo``."""
    p, d = F.col(price).cast("double"), F.col(diff)
    low = F.floor((p + d - STEP - DAMPING * d) / STEP) * STEP
    price_step_up = F.floor((p + (STEP - 1)) / STEP) * STEP
    high = F.floor((p + d + STEP - DAMPING * d) / STEP) * STEP
    df = df.withColumns(
        {
            "estimacion": rounded_estimate(p, d),
            # NULL differences must not fall back to the price alone
            "minimo": F.when(d.isNotNull(), F.greatest(low, price_step_up)).cast("long"),
            "maximo": high.cast("long"),
        }
    )
    number = "\\num{%d}"
    one = F.format_string(number + " €", "minimo")
    both = F.format_string(number + " - " + number + " €", "minimo", "maximo")
    known = F.col("minimo").isNotNull() & F.col("maximo").isNotNull()
    return df.withColumn(
        "intervalo", F.when(known, F.when(F.col("minimo") == F.col("maximo"), one).otherwise(both))
    )
