"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters becomes one blank between words.
Runs of one to ``LONGEST`` characters are hashed into ``BUCKETS`` counters. The
matrix of log probabilities (buckets x languages) is broadcast, and a text's
sparse counts are multiplied with it, batch by batch.

The model learns from ``TRAIN_ROWS`` labelled documents at most, chosen by a
hash of the id, never from held-out ones.

Rows: a null text, and one without any letter, is ``und`` with score 0;
repeated rows are predicted each by itself; rows without a language are not
learned from; other columns are ignored; with nothing to learn from everything
is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasador.llm.splits import bounded_sample, held_out

BUCKETS = 1 << 15
LONGEST = 4
ALPHA = 0.1
TRAIN_ROWS = 50_000
SLICE = 1 << 20
UNKNOWN = "und"

_BLANK = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Letter or not, for every code point; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts per bucket of all n-grams of a text; None if it has no letter."""
    if not text:
        return None
    letter = _is_letter()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter[points], points, np.uint32(_BLANK))
    if not (points != _BLANK).any():
        return None
    points = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.uint64)
    points = points[1:][(points[1:] != _BLANK) | (points[:-1] != _BLANK)]
    points = np.concatenate((np.array([_BLANK], np.uint64), points)) if points[0] != _BLANK else points
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + LONGEST - 1]
        own = min(SLICE, len(points) - at)
        grams = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(part) < n:
                break
            grams = (grams[: len(part) - n + 1] + part[n - 1 :]) * _FACTOR
            grams ^= grams >> np.uint64(29)
            counts += np.bincount(((grams[:own] * _FACTOR) >> shift).astype(np.int64), minlength=BUCKETS)
    return counts


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (buckets x languages) and log shares."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    sample = bounded_sample(
        known.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")),
        "_id",
        train_rows,
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["_text"], batch["_lang"], strict=True):
                counts = gram_counts(text)
                if counts is not None:
                    rows[lang] = rows.get(lang, 0) + 1
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame(
                {"lang": lang, "bucket": np.append(used, -1), "n": np.append(counts[used], rows[lang])}
            )

    summed = (
        sample.drop("_id")
        .mapInPandas(run, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # languages x buckets at most
    )
    langs = sorted(summed["lang"].unique())
    table, shares = np.full((BUCKETS, len(langs)), ALPHA), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = summed[summed["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        table[grams["bucket"].to_numpy(int), i] += grams["n"].to_numpy(float)
        shares[i] = own.loc[own["bucket"] < 0, "n"].sum()
    if langs:
        table, shares = np.log(table / table.sum(0)), np.log(shares / shares.sum())
    return langs, table, shares


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of the chosen language among all) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, table, shares = shared.value
        chosen, scores = [], []
        for text in texts:
            counts = gram_counts(text) if langs else None
            if counts is None:
                chosen.append(UNKNOWN)
                scores.append(0.0)
                continue
            used = np.flatnonzero(counts)
            logs = counts[used] @ table[used] + shares
            best = int(np.argmax(logs))
            chosen.append(langs[best])
            scores.append(float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum()))
        return pd.DataFrame({"lang_pred": chosen, "score": scores})

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id").alias("held_out"),
        guess(F.col("text")).alias("_guess"),
    ).select("doc_id", "held_out", "_guess.*")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that may be learned from, then predict every one."""
    return predict(docs, learn(docs))
