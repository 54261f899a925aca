"""Collocations from count streams in prefix and suffix order.

Texts are turned into word ids with numpy. Frequent words, then frequent pairs, tell
which positions can begin a frequent phrase; such a position gives one window of up to five
words. Windows sorted by their words are a stream in prefix order: the rows of a phrase stand together,
so one pass over the stream gives the counts of all lengths. Counts of first
parts, of rests and of extensions come from sort-merge joins of the count stream
with phrases ordered by their prefix and by their suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tasador.llm.words import mix
from tasador.plans.blocks import positions
from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_lineage

LONGEST = 5
FEWEST = 100
BEST = 2000
CHUNK_BYTES = 2 << 20
FILTER_BITS = 26  # of a table that tells what may be frequent; its size never changes
_KEY = [f"w{i + 1}" for i in range(LONGEST)]

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class _Tokens:
    """Word ids of some texts, one after the other, and where a word follows in the same piece."""

    def __init__(self, texts: Sequence[bytes], langs: Sequence[str], seed: int):
        self.raw = b"\n".join(texts)
        raw = np.frombuffer(self.raw, np.uint8)
        kind = _KIND[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        turn = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        pieces = np.cumsum(kind == 2)
        piece = pieces[self.starts] if len(raw) else self.starts
        self.follows = np.zeros(len(piece), bool)
        self.follows[:-1] = piece[1:] == piece[:-1]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        names = {x: int.from_bytes(hashlib.blake2b(f"{seed}/{x}".encode(), digest_size=8).digest(), "little") for x in set(langs)}
        seeds = np.array([names[x] for x in langs], np.uint64)
        ids = mix(self.hashes(seed) ^ seeds[self.doc])
        ids[ids == 0] = 1  # 0 fills up short phrases
        self.ids = ids

    def hashes(self, seed: int) -> np.ndarray:
        """One hash per word."""
        raw = np.frombuffer(self.raw, np.uint8)
        letters = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)[_lower] * np.uint64(2) + np.uint64(1)
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(letters[raw] * up[: len(raw)], out=total[1:])
        return (total[self.ends] - total[self.starts]) * down[self.starts]

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].lower().decode("utf-8", "replace")


_held: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _held or len(_held["up"]) < n:
        size = max(CHUNK_BYTES + 1, n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _held[name] = np.cumprod(steps)
    return _held["up"], _held["down"]


def _chunks(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[tuple[_Tokens, list[str]]]:
    """Tokens of whole texts, a few megabytes at a time; a longer text is a chunk of its own."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            if texts and size + len(raw) > CHUNK_BYTES:
                yield _Tokens(texts, langs, seed), langs
                texts, langs, size = [], [], 0
            texts.append(raw)
            langs.append(lang)
            size += len(raw) + 1
    if texts:
        yield _Tokens(texts, langs, seed), langs


def _counted(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of equal rows; rows with equal hashes are told apart."""
    hashed = columns[0]
    for c in columns[1:]:
        hashed = mix(hashed * _STEP + c)
    order = np.argsort(hashed, kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _filter_table(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits at the first FILTER_BITS bits of the hashes: a table of 2 ** (FILTER_BITS - 3) bytes whatever their number."""
    place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    bits = hashes.select(F.shiftrightunsigned(place, 6).alias("at"), F.pmod(place, F.lit(64)).cast("int").alias("p"))
    rows = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, p)")).alias("bits"))
    found = rows.toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _words(seed: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, langs in _chunks(batches, seed):
            if not len(tokens.ids):
                continue
            # the second hash tells words with one id apart
            first, count = _counted([tokens.ids, tokens.hashes(-seed % 2**32)])
            docs = tokens.doc[first]
            yield pd.DataFrame(
                {
                    "id": _signed(tokens.ids[first]),
                    "lang": [langs[d] for d in docs],
                    "word": [tokens.word(i) for i in first],
                    "f": count,
                }
            )
            # a row without a word is the number of all words of its lang
            doc = np.bincount(tokens.doc, minlength=len(langs))
            every = pd.DataFrame({"lang": langs, "f": doc}).groupby("lang", as_index=False)["f"].sum()
            yield pd.DataFrame({"id": 0, "lang": every["lang"], "word": None, "f": every["f"]})

    return run


def _pairs(seed: int, words) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, _ in _chunks(batches, seed):
            good = _passes(words.value, tokens.ids)
            at = np.flatnonzero(tokens.follows[:-1] & good[:-1] & good[1:])
            if len(at):
                a, b = tokens.ids[at], tokens.ids[at + 1]
                hashed, count = np.unique(mix(a * _STEP + b), return_counts=True)
                yield pd.DataFrame({"hash": _signed(hashed), "f": count})

    return run


def _windows(seed: int, words, pairs) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, _ in _chunks(batches, seed):
            ids, n = tokens.ids, len(tokens.ids)
            good = _passes(words.value, ids)
            link = np.zeros(n + LONGEST, bool)
            if n > 1:
                link[: n - 1] = tokens.follows[:-1] & good[:-1] & good[1:]
                at = np.flatnonzero(link[: n - 1])
                link[at] = _passes(pairs.value, mix(ids[at] * _STEP + ids[at + 1]))
            at = np.flatnonzero(link[:n])
            if not len(at):
                continue
            padded = np.concatenate((ids, np.zeros(LONGEST, np.uint64)))
            columns, goes = [ids[at], padded[at + 1]], link[at]
            for k in range(2, LONGEST):
                goes = goes & link[at + k - 1]
                columns.append(np.where(goes, padded[at + k], np.uint64(0)))
            first, count = _counted(columns)
            yield pd.DataFrame({**{name: _signed(c[first]) for name, c in zip(_KEY, columns)}, "f": count})

    return run


def _prefix_counts(fewest: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of phrases of 2 words and more in sorted windows; parts of what crosses a batch's edge."""
        for batch in batches:
            words, f = batch[_KEY].to_numpy(np.int64), batch["f"].to_numpy(np.int64)
            for k in range(2, LONGEST + 1):
                at = np.flatnonzero(words[:, k - 1])
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                # a phrase's windows stand together, so what differs between neighbours tells
                new[1:] = (words[at][1:, :k] != words[at][:-1, :k]).any(axis=1)
                starts = np.flatnonzero(new)
                total = np.add.reduceat(f[at], starts)
                prefix = words[at[starts], :k]
                edge = (prefix == words[0, :k]).all(axis=1) | (prefix == words[-1, :k]).all(axis=1)
                keep = (total >= fewest) | edge
                out = np.zeros((int(keep.sum()), LONGEST), np.int64)
                out[:, :k] = prefix[keep]
                yield pd.DataFrame({**{name: out[:, i] for i, name in enumerate(_KEY)}, "f": total[keep]})

    return run


def _padded(words: Sequence, longest: int = LONGEST) -> list:
    return [*words, *[F.lit(0).cast("long")] * (longest - len(words))]


def count_phrases(docs: DataFrame, fewest: int = FEWEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (w1..w5, k, f) of all phrases of 1 to 5 words that occur ``fewest`` times, in prefix order; words (id, lang, word); totals (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed, clashes = 0, 1
    while clashes:
        seed += 1
        told = docs.mapInPandas(_words(seed), "id long, lang string, word string, f long")
        grouped = told.groupBy("id", F.when(F.col("word").isNull(), F.col("lang")).alias("of")).agg(
            F.sum("f").alias("f"), *[g(c).alias(f"{c}{n}") for c in ("lang", "word") for n, g in enumerate((F.min, F.max))]
        )
        clash = F.count_if((F.col("lang0") != F.col("lang1")) | (F.col("word0") != F.col("word1")))
        seen = Observation()
        # two words with one id: all again with other ids
        kept = grouped.observe(seen, clash.alias("clashes")).where((F.col("f") >= fewest) | F.col("of").isNotNull())
        kept = cut_lineage(kept.select("id", F.col("lang0").alias("lang"), F.col("word0").alias("word"), "f"), "words")
        clashes = seen.get["clashes"]
    totals = kept.where("word is null").select("lang", F.col("f").alias("n"))
    words = kept.where("word is not null")
    word_bits = spark.sparkContext.broadcast(_filter_table(words, "id"))
    # a pair's hash is enough to rule it out; what passes by chance is counted exactly with the rest
    pairs = docs.mapInPandas(_pairs(seed, word_bits), "hash long, f long")
    pairs = pairs.groupBy("hash").agg(F.sum("f").alias("f")).where(F.col("f") >= fewest)
    pair_bits = spark.sparkContext.broadcast(_filter_table(pairs, "hash"))
    counted = ", ".join(f"{w} long" for w in _KEY) + ", f long"
    windows = docs.mapInPandas(_windows(seed, word_bits, pair_bits), counted)
    windows = cut_lineage(windows.groupBy(*_KEY).agg(F.sum("f").alias("f")), "windows")
    ordered = windows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    longer = ordered.mapInPandas(_prefix_counts(fewest), counted).groupBy(*_KEY).agg(F.sum("f").alias("f"))
    stream = (
        words.select(*[c.alias(n) for c, n in zip(_padded([F.col("id")]), _KEY)], "f")
        .unionByName(longer.where(F.col("f") >= fewest))
    )
    length = sum(((F.col(w) != 0).cast("int") for w in _KEY[1:]), F.lit(1))
    stream = stream.withColumn("k", length).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    return cut_lineage(stream, "counts"), words, totals


def _parts(key: Sequence[str], start, length) -> list:
    """The ``length`` words from ``start`` on, filled up."""
    words = F.array(*[F.col(w) for w in key])
    return [F.when(F.lit(i) < length, F.get(words, start + i)).otherwise(F.lit(0).cast("long")) for i in range(len(key))]


def collocations(docs: DataFrame, fewest: int = FEWEST, best: int = BEST) -> DataFrame:
    """Each lang's ``best`` phrases: (lang, rank, phrase, a, l, r, n, score).

    Words are runs of anything but blank and tab inside pieces between marks and line
    ends, A-Z in lower case. A phrase of 2 to 5 words that occurs ``fewest`` times scores by its
    weakest cut, the smallest of equal ones; one that a longer phrase of equal
    count contains goes. Null langs count as ``und``, null texts as empty;
    repeated rows count each, extra columns are ignored, an empty table gives no rows. Equal
    scores go by count, then phrase in byte order. Counts and scores are exact.
    """
    counts, words, totals = count_phrases(docs, fewest)
    phrases = counts.where("k > 1")
    # longer phrases in the order of their first and of their last words meet the count stream
    longer = counts.where("k > 2")
    by_prefix = longer.select(*[c.alias(n) for c, n in zip(_parts(_KEY, F.lit(0), F.col("k") - 1), _KEY)], F.col("f").alias("ext"))
    by_suffix = longer.select(*[c.alias(n) for c, n in zip(_parts(_KEY, F.lit(1), F.col("k") - 1), _KEY)], F.col("f").alias("ext"))
    extended = by_prefix.unionByName(by_suffix).groupBy(*_KEY).agg(F.max("ext").alias("ext"))
    # what a longer phrase drops is contained in one that is a word longer, too: counts only fall on the way
    kept = phrases.join(extended.hint("merge"), _KEY, "left").where("ext is null or ext < f").drop("ext")
    kept = kept.withColumnRenamed("f", "a").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    names = [f"p{w}" for w in _KEY]
    lookup = lambda name: counts.select(*[F.col(w).alias(n) for w, n in zip(_KEY, names)], F.col("f").alias(name)).hint("merge")
    for name, start, length in (("l", F.lit(0), F.col("cut")), ("r", F.col("cut"), F.col("k") - F.col("cut"))):
        part = [c.alias(n) for c, n in zip(_parts(_KEY, start, length), names)]
        kept = kept.select("*", *part).join(lookup(name), names).drop(*names)
    told = checked_join(words.select("id", "lang", "word"), totals, ["lang"])
    kept = checked_join(kept, told.select(F.col("id").alias("w1"), "lang", "n"), ["w1"], salt=_KEY[1:])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    top = (whole("a") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    kept = kept.withColumn("_top", top.cast("decimal(38,0)")).withColumn("_below", (whole("l") * whole("r")).cast("decimal(38,0)"))
    kept = kept.withColumn("score", F.expr("_top div _below").cast("long"))
    kept = kept.groupBy(*_KEY, "k", "a", "lang", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    kept = cut_lineage(kept.select(*_KEY, "k", "a", "lang", "n", "m.score", "m.l", "m.r"), "scored")
    spelled = kept.select(*_KEY, F.posexplode(F.slice(F.array(*_KEY), F.lit(1), F.col("k"))).alias("at", "id"))
    spelled = checked_join(spelled, words.select("id", "word"), ["id"], salt=["w1", "w2", "at"])
    spelled = spelled.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda s: s["word"]), " ")
    kept = kept.join(spelled.select(*_KEY, phrase.alias("phrase")), _KEY)
    kept = kept.select("lang", "phrase", "a", "l", "r", "n", "score", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    ranked = positions(kept, ["lang"], ["_s", "_a", "phrase"], "rank").withColumn("rank", (F.col("rank") + 1).cast("long"))
    return ranked.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
