"""Packing documents into sequences of a fixed length by fitted patterns.

1. Each text becomes ids plus an end id and is cut into pieces of at most
   ``most`` ids; only narrow rows (place, length, checksum) go on.
2. The histogram of piece lengths, ``most`` numbers at most, is all that reaches
   the driver. Patterns of up to three lengths that fill a sequence exactly are
   enumerated, their repeat counts are fitted to the histogram by non-negative
   least squares, rounded, and held to what the histogram has. What is left is
   packed best-fit, longest first, again as counts per length.
3. Each pattern repeated n times takes n pieces of each of its lengths, so the
   r-th piece of a length finds its sequence and offset in a sorted table whose
   size depends on ``most`` and not on the number of documents. Ranks come
   from counts per (length, salt), so a hot length is spread over many tasks.

Rows: a null text counts as empty and is one piece, the end id alone; repeated
rows are packed each by itself; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tasador.plans.lineage import cut_lineage, cut_measured

MOST = 2048
END_ID = 0
PER_SALT = 1_000
REMEMBERED = 120_000
FIT_STEPS = 400


class _Words(dict):
    """Words to ids, found when first asked for, remembered up to a bound."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.find(word)
        return ids


class WordTokenizer:
    """Ids of a word-based tokenizer file, remembering words.

    Texts made of plain Latin characters are split into the file's words here
    and each distinct word is encoded once by the library; any other text goes
    to the library whole, because normalising it may join or change characters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250))]
        lowered = {c for p in plain for c in p.lower()}
        letters = re.escape("".join(sorted(c for c in lowered if unicodedata.category(c)[0] == "L")))
        numbers = re.escape("".join(sorted(c for c in lowered if unicodedata.category(c)[0] == "N")))
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.other = re.compile(f"[^{re.escape(''.join(plain))}\\t-\\r]|<\\|")
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.remembered = _Words(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of one word by the library's model; outside ASCII its bytes are spelt the way the model spells them."""
        spelt = word if word.isascii() else self.as_bytes(word)[0][0]
        return np.array([t.id for t in self.library.model.tokenize(spelt)], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        known = self.remembered.__getitem__
        return [
            b""
            if not text
            else self.whole(text)
            if self.other.search(text)
            else b"".join(map(known, self.words.findall(text.lower())))
            for text in texts
        ]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, one per worker process."""
    return WordTokenizer(path)


def pieces(path: str, text: Column, most: int = MOST) -> Column:
    """Array of (piece, start, length, ids_crc32) of a text column."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(texts: pd.Series) -> pd.Series:
        coded = tokenizer(path).encode(texts)
        end = np.array([END_ID], "<u4").tobytes()
        rows = []
        for raw in coded:
            raw += end
            rows.append(
                [
                    {"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    for i, at in enumerate(range(0, len(raw), 4 * most))
                    if (part := raw[at : at + 4 * most])
                ]
            )
        return pd.Series(rows, dtype=object)

    return cut(text)


def exact_patterns(most: int, lengths: np.ndarray) -> np.ndarray:
    """All sets of one to three of the lengths that add up to ``most``: rows of three, ascending, 0 for none."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for first in np.flatnonzero(there[: most // 3 + 1]):
        seconds = np.arange(first, (most - first) // 2 + 1)
        seconds = seconds[there[seconds] & there[most - first - seconds]]
        found.append(np.stack([np.full(len(seconds), first), seconds, most - first - seconds], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the length counts, by accelerated projected descent.

    Leftover long pieces are dearer than leftover short ones, which still fit
    anywhere, so the error of a length is weighted with its share of a sequence.
    """
    most = len(counts) - 1
    used = patterns > 0
    weight = np.arange(most + 1) / most
    flat, target = patterns.ravel(), counts * weight
    uses = np.bincount(flat, minlength=most + 1).astype(float)
    uses[0] = 0
    x = np.zeros(len(patterns))
    ahead, pace = x, 1.0
    # diagonal steps: a pattern's slope meets at most the patterns that share its lengths
    rate = 1 / np.maximum((used * weight[patterns] ** 2 * uses[patterns]).sum(1), 1e-12)
    for _ in range(steps):
        made = np.bincount(flat, np.repeat(ahead, 3), most + 1) * weight
        made[0] = 0
        error = (made - target) * weight
        new = np.maximum(ahead - rate * error[patterns].sum(1), 0)
        quicker = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, x, pace = new + (pace - 1) / quicker * (new - x), new, quicker
    return x


def rounded(patterns: np.ndarray, fitted: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats that the counts allow, and what is left of the counts.

    Sums over neighbouring patterns are rounded, so that many small shares do
    not all round to nothing.
    """
    left = counts.copy()
    whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(fitted))) + 0.5)).astype(int)
    chosen = []
    for i in np.flatnonzero(whole):
        parts = [int(n) for n in patterns[i] if n]
        repeat = min([int(whole[i])] + [int(left[n]) // parts.count(n) for n in parts])
        if repeat > 0:
            for n in parts:
                left[n] -= repeat
            chosen.append((tuple(sorted(parts, reverse=True)), repeat))
    return chosen, left


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts per length: patterns and repeats."""
    most = len(counts) - 1
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space: int, parts: tuple[int, ...], n: int) -> None:
        if space not in open_at:
            open_at[space] = []
            spaces.insert(bisect_left(spaces, space), space)
        open_at[space].append((parts, n))

    for length in range(most, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                each = most // length
                if left >= each:
                    put(most - each * length, (length,) * each, left // each)
                if left % each:
                    put(most - left % each * length, (length,) * (left % each), 1)
                break
            space = spaces[i]
            parts, n = open_at[space].pop()
            if not open_at[space]:
                del open_at[space], spaces[i]
            each = min(space // length, left)
            filled = min(n, left // each)
            if n > filled:
                put(space, parts, n - filled)
            put(space - each * length, parts + (length,) * each, filled)
            left -= each * filled
    return [group for groups in open_at.values() for group in groups]


@dataclass
class Layout:
    """Where the r-th piece of each length goes; arrays sorted by (length, first rank)."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        return self.sequence[at] + rank - (self.key[at] & ((1 << 44) - 1)), self.offset[at]


def plan(counts: np.ndarray) -> Layout:
    """Patterns for the counts per length (index 0 unused) and where they put the pieces."""
    counts = np.asarray(counts, np.int64)
    most = len(counts) - 1
    patterns = exact_patterns(most, np.flatnonzero(counts))
    chosen, left = rounded(patterns, fit_repeats(patterns, counts.astype(float)), counts) if len(patterns) else ([], counts)
    taken = np.zeros(most + 1, np.int64)
    slots: list[tuple[int, int, int]] = []
    sequence = 0
    for parts, repeat in (*chosen, *best_fit(left)):
        at = 0
        for n in parts:
            slots.append(((n << 44) + int(taken[n]), sequence, at))
            taken[n] += repeat
            at += n
        sequence += repeat
    if not (taken == counts).all():
        raise RuntimeError("a piece was packed twice or not at all")
    table = np.array(sorted(slots), np.int64).reshape(-1, 3)
    return Layout(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), sequence)


def pack_documents(docs: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.explode(pieces(path, F.col("text"), most)).alias("_piece")
    ).select("doc_id", "_piece.*", F.monotonically_increasing_id().alias("_row"))
    rows, found = cut_measured(cut, "pieces", n=F.count(F.lit(1)))
    salts = -(-(found["n"] or 0) // PER_SALT) or 1
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))

    by_salt = cut_lineage(rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = np.zeros(most + 1, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``most`` rows
        counts[row["length"]] = row["n"]
    layout = spark.sparkContext.broadcast(plan(counts))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = layout.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("_row")
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(bases, ["length", "_salt"])
    placed = ranked.withColumn("_place", place(F.col("length"), F.col("_own") + F.col("_base")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.*")
