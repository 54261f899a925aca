"""Text columns in, columns out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish and other feature text uses no-break spaces, which only count as
# white space (and other scripts' digits as digits) under this flag.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+$", "")


def extract_int(text: Column, pattern: str) -> Column:
    """First capture of the first match as INT, NULL without one."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, 1), F.lit("")).try_cast("int")


def extract_text(text: Column, pattern: str, default: str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(text, UNICODE + pattern, 1), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def first_match_label(
    text: Column, labels: Sequence[tuple[str, str]], default: str | None = None
) -> Column:
    """Label of the first wording found in the lower-cased text."""
    low = F.lower(text)
    chain = reduce(
        lambda c, pair: c.when(F.contains(low, F.lit(pair[0])), F.lit(pair[1])),
        labels[1:],
        F.when(F.contains(low, F.lit(labels[0][0])), F.lit(labels[0][1])),
    )
    return chain.otherwise(F.lit(default))


def keyword_flag(
    text: Column,
    needles: Iterable[str],
    case_sensitive: bool = False,
    word_boundary: bool = False,
) -> Column:
    """1 if any needle occurs in the text, else 0; a missing text has none."""
    hay = text if case_sensitive else F.lower(text)
    wanted = [n if case_sensitive else n.lower() for n in needles]
    if word_boundary:
        hits = [hay.rlike(UNICODE + r"\b" + _quote(n) + r"\b") for n in wanted]
    else:
        hits = [F.contains(hay, F.lit(n)) for n in wanted]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)).cast("int")


def _quote(needle: str) -> str:
    return r"\Q" + needle + r"\E"


def split_list(text: Column, lower: bool = False) -> Column:
    """``'a, ,b '`` -> ``['a', 'b']``; NULL -> empty."""
    items = F.transform(F.split(text, ","), strip)
    items = F.filter(items, lambda x: x != "")
    if lower:
        items = F.transform(items, F.lower)
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_id_list(text: Column) -> Column:
    """``'[3, 7]'`` as found in files -> array of ids."""
    return F.from_json(text, "array<bigint>")


def strip_accents(text: Column) -> Column:
    """Base letters only: compatibility forms resolved, combining marks removed.

    ASCII text is not handed to Python: it cannot change.
    """

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)),
            na_action="ignore",
        )

    return F.coalesce(plain(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=1)
def _entity_table() -> str:
    return "\x02".join(f"{name[:-1]}\x01{chars}" for name, chars in sorted(html5.items()) if name.endswith(";"))


def _decode_entity(part: Column) -> Column:
    """What follows an ampersand, with the entity it starts with (if any) decoded."""
    named = F.str_to_map(F.lit(_entity_table()), F.lit("\x02"), F.lit("\x01"))

    def decoded(name: Column) -> Column:
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        code = F.when(
            name.rlike("^#[xX]"), F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("long"))
        ).otherwise(digits.try_cast("long"))
        # surrogates and numbers beyond the last code point name no character
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(named, name))
        rest = F.substr(part, F.length(name) + F.lit(2))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))

    name = F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
    return bind(name, decoded)


def unescape_entities(text: Column) -> Column:
    """Decode ``&name;``, ``&#10;`` and ``&#xA;``; unknown names stay as they are."""

    def joined(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _decode_entity)
        return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))

    return bind(
        text, lambda t: F.when(F.contains(t, F.lit("&")), bind(F.split(t, "&"), joined)).otherwise(t)
    )


def capitalise_words(text: Column) -> Column:
    """``'aire_acondicionado,terraza'`` -> ``'Aire Acondicionado, Terraza'``."""
    spaced = F.replace(F.replace(text, F.lit(","), F.lit(", ")), F.lit("_"), F.lit(" "))
    return F.initcap(F.regexp_replace(strip(spaced), UNICODE + r"\s+", " "))


def dotted_number(number: Column) -> Column:
    """Thousands separated by dots; decimals keep their own dot as well."""
    value = number.cast("double")
    whole = F.format_number(value, 0)
    cents = F.regexp_replace(F.format_number(value, 2), "0$", "")
    return F.translate(F.when(value == F.floor(value), whole).otherwise(cents), ",", ".")


def plain_number(number: Column) -> Column:
    """``3.0`` -> ``3``, ``2.456`` -> ``2.46``."""
    value = number.cast("double")
    whole = F.floor(value).cast("string")
    cents = F.regexp_replace(F.replace(F.format_number(value, 2), F.lit(","), F.lit("")), "0$", "")
    return F.when(value == F.floor(value), whole).otherwise(cents)
