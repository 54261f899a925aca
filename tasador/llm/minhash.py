"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set holds the hashes of its runs of five words. Its signature has
``SYMBOLS`` b-bit minima. Two sets of similarity J differ in each symbol with
probability 1 - J. The signature is split into ``CHUNKS`` chunks; by pigeonhole,
two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have
a chunk with at most ``ERRORS`` differences. For one error, a chunk gives one
key per symbol left out, so such pairs are sure to share a key. With 40 symbols,
8 chunks and 1 error all pairs within 15 differing symbols meet; at a similarity
of 0.85 fewer than one pair in ten thousand differs in more, and most of
those still meet. Below 0.85 there are 10 chunks of 4 symbols, so all pairs within
19 differing symbols meet, which holds at 0.8 for all but one pair in fifty thousand;
below 0.8 more are missed.

Documents with equal sets form one class and are looked at once. A key that
many classes share is not expanded into all pairs:

1. each class is compared, on full sets, with three pivots of each of its keys,
   the first being the class that shares most keys with others;
2. links give components;
3. where classes around one pivot c still are in several components, pairs of
   different components are compared unless the pivot rules them out. What two
   sets b and x have in common lies in c or is an addition to c that both made.
   With s shared additions at most m = min(|b & c|, |x & c|) + s is common, so their
   similarity is at most m / (|b| + |x| - m). Pairs that this bound lets pass are
   compared; no other can be linked. Additions that more than ``HOT_ADDITION``
   classes share are counted as part of c, so pairs meet by rare additions only.

So no link between different components is lost among classes around a pivot,
and what a class is linked with inside its own component changes nothing.
Texts, not sets, are moved to where pairs are compared: they are smaller.

Rows: null texts and texts without words have an empty set and are linked with
nothing; repeated rows are in one class; a null id counts as the largest; an
empty table gives an empty result; other columns are carried along unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasador.llm.components import components
from tasador.llm.words import mix, shingles
from tasador.plans.lineage import cut_lineage

WORDS = 5
SYMBOLS = 40
CHUNKS = 8
WIDE_CHUNKS = 10
ERRORS = 1
BITS = 16
PERCENT = 85
HOT_ADDITION = 16
CLOSE = 8

_seeds = np.random.default_rng(41)
_FACTORS = _seeds.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_FACTORS = _seeds.integers(1, 2**63, SYMBOLS // CHUNKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` minima of ``BITS`` bits each of a set's hashes."""
    minima = np.fromiter(((hashes * f).min() for f in _FACTORS), np.uint64, SYMBOLS)
    return mix(minima) >> np.uint64(64 - BITS)


def chunks_for(percent: int) -> int:
    """The number of chunks with which pairs of this similarity meet."""
    return CHUNKS if percent >= PERCENT else WIDE_CHUNKS


def chunk_keys(symbols: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """One key per chunk and symbol left out of it: equal for signatures that differ there in that symbol only."""
    per = SYMBOLS // chunks
    parts = symbols.reshape(chunks, per) + np.uint64(1)
    weighted = mix(parts * _KEY_FACTORS[:per])
    without = weighted.sum(axis=1, dtype=np.uint64)[:, None] - weighted
    place = np.arange(SYMBOLS, dtype=np.uint64).reshape(chunks, per) * np.uint64(0x9E3779B97F4A7C15)
    return mix(without + place).ravel().view(np.int64)


def marks_column(text: Column) -> Column:
    """Set size, a 128-bit name of the set, and the signature of a text."""

    @F.pandas_udf("n_shingles long, k1 long, k2 long, signature binary")
    def marks(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingles(t, WORDS)
            if not len(hashes):
                rows.append((0, None, None, None))
                continue
            places = np.arange(1, len(hashes) + 1, dtype=np.uint64)
            names = (mix(hashes + places * f).sum(dtype=np.uint64).view(np.int64) for f in _KEY_FACTORS[:2])
            rows.append((len(hashes), *names, signature(hashes).astype(np.uint16).tobytes()))
        frame = pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "signature"], dtype=object)
        return frame.astype({"n_shingles": "int64", "k1": "Int64", "k2": "Int64"})

    return marks(text)


def keys_column(signature: Column, chunks: int = CHUNKS) -> Column:
    """The keys of a signature."""

    @F.pandas_udf("array<long>")
    def keys(series: pd.Series) -> pd.Series:
        return pd.Series([chunk_keys(np.frombuffer(x, np.uint16).astype(np.uint64), chunks) for x in series], dtype=object)

    return keys(signature)


class _Recent(dict):
    """Sets of the last texts looked at: pairs with one pivot come together."""

    def __missing__(self, text: str) -> np.ndarray:
        if len(self) >= 256:
            self.clear()
        found = self[text] = shingles(text, WORDS)
        return found


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with both texts, rows of one ``b`` together."""
    one = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return one.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, inter) of pairs of classes, on full sets."""

    @F.pandas_udf("size_a long, size_b long, inter long")
    def overlap(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        known, rows = _Recent(), []
        for s, t in zip(left, right, strict=True):
            x, y = shingles(s, WORDS), known[t]
            rows.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        return pd.DataFrame(rows, columns=["size_a", "size_b", "inter"])

    both = _with_texts(pairs, texts)
    return both.select("a", "b", overlap("text_a", "text_b").alias("o")).select("a", "b", "o.*")


def _additions(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, h) for every shingle h of ``a`` that ``b`` has not."""

    @F.pandas_udf("array<long>")
    def added(left: pd.Series, right: pd.Series) -> pd.Series:
        known = _Recent()
        rows = [np.setdiff1d(shingles(s, WORDS), known[t], assume_unique=True) for s, t in zip(left, right, strict=True)]
        return pd.Series([r.view(np.int64) for r in rows], dtype=object)

    both = _with_texts(pairs, texts)
    return both.select("a", "b", F.explode(added("text_a", "text_b")).alias("h"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    union = F.col("size_a") + F.col("size_b") - F.col("inter")
    return compared.where(100 * F.col("inter") >= percent * union).select("a", "b")


def _open_pairs(entries: DataFrame, near: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b, far) of different components around one pivot that the pivot does not rule out.

    ``far`` orders the partners of an ``a`` by how far they are from the pivot.
    """
    placed = entries.where(F.col("n") > 3).select("p0", "cid").distinct()  # up to three have all met a pivot
    placed = placed.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    placed = cut_lineage(placed.withColumn("label", F.coalesce("label", "cid")), "placed")
    mixed = (
        placed.groupBy("p0", "label")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("p0")
        .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "label")).alias("largest"))
        .where(F.col("parts") > 1)
        .select("p0", F.col("largest.label").alias("main"))
    )
    figures = near.select(F.col("a").alias("cid"), F.col("b").alias("p0"), F.col("size_a").alias("size"), "inter")
    members = placed.join(cut_lineage(mixed, "mixed"), "p0").join(figures, ["p0", "cid"])
    members = cut_lineage(members, "members")

    # additions that many share count as part of what all are compared with
    added = _additions(members.select(F.col("cid").alias("a"), F.col("p0").alias("b")), texts)
    added = cut_lineage(added.select(F.col("a").alias("cid"), F.col("b").alias("p0"), "h"), "additions")
    times = added.groupBy("p0", "h").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    added = cut_lineage(added.join(cut_lineage(times, "times"), ["p0", "h"]), "shared-additions")
    common = added.where(F.col("times") > HOT_ADDITION).groupBy("p0", "cid").agg(F.count(F.lit(1)).alias("common"))
    members = members.join(common, ["p0", "cid"], "left").withColumn("inter", F.col("inter") + F.coalesce("common", F.lit(0)))
    members = cut_lineage(members.drop("common"), "members")

    once = (F.col("r.label") == F.col("r.main")) | (F.col("l.cid") < F.col("r.cid"))
    apart = (F.col("l.label") != F.col("r.label")) & once

    def may_be_linked(shared: Column) -> Column:
        most = F.least(F.col("l.inter"), F.col("r.inter")) + shared
        return 100 * most >= percent * (F.col("l.size") + F.col("r.size") - most)

    # without shared additions the other's size is bounded on both sides: they meet in narrow bands of sizes
    def band(size: Column) -> Column:
        return F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log(1.02)).cast("int")

    least, most = F.col("size") * (percent / 100), F.col("inter") * ((100 + percent) / percent) - F.col("size")
    bands = F.when(most >= least, F.sequence(band(least) - 1, band(most) + 1))
    reach = members.where(F.col("label") != F.col("main")).withColumn("band", F.explode(bands)).alias("l")
    sized = members.withColumn("band", band(F.col("size"))).alias("r")
    tests = [F.col("l.p0") == F.col("r.p0"), F.col("l.band") == F.col("r.band"), apart, may_be_linked(F.lit(0))]
    pair = [F.col("l.cid").alias("a"), F.col("r.cid").alias("b")]
    far = F.col("r.size") - 2 * F.col("r.inter")
    alone = reach.join(sized, tests).select(*pair, far.alias("far"))

    rare = added.where(F.col("times") <= HOT_ADDITION).select("p0", "h", "cid")
    told = rare.join(members, ["p0", "cid"])
    left, right = told.where(F.col("label") != F.col("main")).alias("l"), told.alias("r")
    together = (
        left.join(right, [F.col("l.p0") == F.col("r.p0"), F.col("l.h") == F.col("r.h"), apart])
        .groupBy(F.col("l.p0").alias("p0"), *pair)
        .agg(
            F.count(F.lit(1)).alias("shared"),
            F.first(F.least("l.inter", "r.inter")).alias("most"),
            F.first(F.col("l.size") + F.col("r.size")).alias("sizes"),
            F.first(far).alias("far"),
        )
        .withColumn("most", F.col("most") + F.col("shared"))
        .where(100 * F.col("most") >= percent * (F.col("sizes") - F.col("most")))
        .select("a", "b", "far")
    )
    return alone.unionByName(together).groupBy("a", "b").agg(F.min("far").alias("far"))


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in different components."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    told = pairs.join(a, "a", "left").join(b, "b", "left")
    return told.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def mark_rows(docs: DataFrame, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(r1, r2, id, n_shingles, component_id, kept) of every row: r1 and r2 name the row by id and text.

    ``kept`` is true for the row with the smallest id of each group (by row name, if it
    repeats) and for every row without words.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [F.xxhash64("id", "text").alias("r1"), F.xxhash64(F.lit("row"), "text", "id").alias("r2")]
    rows = source.select("id", *names, marks_column(F.col("text")).alias("m")).select("id", "r1", "r2", "m.*")
    rows = cut_lineage(rows, "marks")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")
    classes = (
        rows.where(F.col("k1").isNotNull())
        .groupBy("k1", "k2")
        .agg(F.min(order).alias("best"), F.first("signature").alias("signature"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = cut_lineage(classes, "classes")

    held = classes.select("cid", F.explode(keys_column(F.col("signature"), chunks_for(percent))).alias("key"))
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    entries = cut_lineage(held.join(cut_lineage(counts, "counts").hint("merge"), "key"), "entries")
    often = entries.groupBy("cid").agg(F.sum("n").alias("often"))
    pivots = (
        entries.join(often, "cid")
        .groupBy("key")
        .agg(F.max(F.struct("often", "cid")).alias("most"), F.min("cid").alias("p1"), F.max("cid").alias("p2"))
        .select("key", F.col("most.cid").alias("p0"), "p1", "p2")
    )
    entries = cut_lineage(entries.join(cut_lineage(pivots, "pivots"), "key"), "placed-keys")
    stars = entries.select(F.col("cid").alias("a"), F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("b"))
    stars = cut_lineage(stars.where(F.col("a") != F.col("b")).distinct(), "stars")

    involved = stars.select(F.col("a").alias("cid")).unionByName(stars.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.join(involved, "cid").select("cid", F.col("best.r1").alias("r1"), F.col("best.r2").alias("r2"))
    texts = source.select("text", *names).join(wanted.hint("merge"), ["r1", "r2"]).select("cid", "text")
    texts = cut_lineage(texts.dropDuplicates(["cid"]), "texts")
    near = cut_lineage(_compared(stars, texts), "near")
    links = cut_lineage(_linked(near, percent), "links")
    labels = components(links)
    turn = F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))
    rest = cut_lineage(_open_pairs(entries, near, labels, texts, percent), "rest")
    # most that are linked at all are linked with what is close to the pivot; only the others meet all their partners
    first = cut_lineage(rest.withColumn("turn", turn).where(F.col("turn") <= CLOSE).select("a", "b"), "first")
    for chosen_pairs in (lambda: first, lambda: _still_apart(rest, labels).join(first, ["a", "b"], "left_anti")):
        pairs = cut_lineage(chosen_pairs(), "pairs")
        more = cut_lineage(_linked(_compared(pairs, texts), percent), "more-links")
        if not more.isEmpty():
            links = cut_lineage(links.unionByName(more), "links")
            labels = components(links)

    grouped = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    grouped = cut_lineage(grouped.select("k1", "k2", "best", F.coalesce("label", "cid").alias("label")), "grouped")
    best = grouped.groupBy("label").agg(F.min("best").alias("winner"))
    chosen = cut_lineage(grouped.join(best, "label").select("k1", "k2", "winner"), "winners")
    found = rows.where(F.col("k1").isNotNull()).join(chosen, ["k1", "k2"])
    is_winner = (F.col("r1") == F.col("winner.r1")) & (F.col("r2") == F.col("winner.r2"))
    own = ["r1", "r2", "id", "n_shingles"]
    alone = rows.where(F.col("k1").isNull()).select(*own, F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return alone.unionByName(found.select(*own, F.col("winner.id").alias("component_id"), is_winner.alias("kept")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is the smallest of its component) of every document."""
    return mark_rows(docs, percent).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one of each group; documents without words all stay.

    A row that is repeated with id and text stays once if it has words.
    """
    own = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.xxhash64(*own).alias("r1"),
        F.xxhash64(F.lit("row"), *own[::-1]).alias("r2"),
    )
    marked = mark_rows(docs, percent).where("kept").select("r1", "r2", (F.col("n_shingles") > 0).alias("_told")).distinct()
    kept = rows.join(marked.hint("merge"), ["r1", "r2"])
    # numbering is only needed where rows repeat; the names are spread evenly
    repeat = F.row_number().over(Window.partitionBy("r1", "r2").orderBy(F.lit(0)))
    return kept.withColumn("_n", repeat).where((F.col("_n") == 1) | ~F.col("_told")).select("_doc.*")
