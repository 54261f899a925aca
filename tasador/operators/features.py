"""Feature text to columns, and the clean-up before training and charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasador import rules
from tasador.functions.money import price_per_area
from tasador.functions.text import extract_int, extract_text, first_match_label, keyword_flag


def extract_ints(df: DataFrame, text: str, patterns: Mapping[str, str], lower: bool = False) -> DataFrame:
    source = F.lower(text) if lower else F.col(text)
    return df.withColumns({c: extract_int(source, p) for c, p in patterns.items()})


def keyword_flags(
    df: DataFrame,
    text: str,
    flags: Mapping[str, Sequence[str]],
    case_sensitive: bool = False,
    word_boundary: bool = False,
) -> DataFrame:
    """One 0/1 column per entry, set if any of its wordings occurs."""
    return df.withColumns(
        {c: keyword_flag(F.col(text), words, case_sensitive, word_boundary) for c, words in flags.items()}
    )


def extract_features(
    df: DataFrame,
    basic: str = "Caracteristicas_basicas",
    extra: str = "Caracteristicas_extra",
    legacy: bool = False,
) -> DataFrame:
    """All feature columns from the two text columns, which are dropped with the title.

    ``legacy`` follows the older extraction: its condition labels, capitalised
    storage/terrace/balcony wording, and the singular for wardrobes.
    """
    flags = {**rules.BASIC_FLAGS, **rules.SIDE_FLAGS, **rules.ORIENTATION_FLAGS}
    cased: dict[str, list[str]] = {}
    if legacy:
        cased = rules.LEGACY_CASED_FLAGS
        flags = {c: w for c, w in flags.items() if c not in cased}
        flags["armarios_empotrados"] = rules.LEGACY_WARDROBE
    text = F.col(basic)
    df = extract_ints(df, basic, rules.INT_PATTERNS)
    df = extract_ints(df, basic, rules.LOWERED_INT_PATTERNS, lower=True)
    df = df.withColumns(
        {
            "estado_vivienda": first_match_label(
                text, rules.LEGACY_CONDITIONS if legacy else rules.CONDITIONS
            ),
            "Calefacción": extract_text(text, rules.HEATING_PATTERN, rules.NO_HEATING),
        }
    )
    df = keyword_flags(df, basic, flags)
    df = keyword_flags(df, basic, cased, case_sensitive=True)
    df = keyword_flags(df, extra, rules.EXTRA_FLAGS)
    return df.drop("Titulo", basic, extra)


def cross_fill_areas(
    df: DataFrame, built: str = "m2_construidos", usable: str = "m2_utiles"
) -> DataFrame:
    """Each area stands in for the other; rows without any are dropped."""
    return df.withColumns(
        {built: F.coalesce(built, usable), usable: F.coalesce(usable, built)}
    ).dropna(subset=[built, usable])


def fill_constants(df: DataFrame, zero: Sequence[str] = ("planta_numero",)) -> DataFrame:
    """Missing floors are 0, missing text is a category of its own."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.fillna(0, subset=list(zero)) if zero else df
    return df.fillna(rules.UNKNOWN, subset=texts) if texts else df


def impute_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill numeric columns with their means: one aggregation, one row to the driver."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    # all-NULL columns have no mean and stay as they are
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in means.items() if m is not None}
    )


def with_price_per_area(
    df: DataFrame, price: str = "Precio", area: str = "m2_construidos", name: str = "eur_m2"
) -> DataFrame:
    """Add price per m²; rows without it (no price, no or zero area) are dropped."""
    return df.withColumn(name, price_per_area(F.col(price), F.col(area))).dropna(subset=[name])
