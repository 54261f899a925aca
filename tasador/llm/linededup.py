"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is a piece of a text between line feeds, trimmed of blanks, tabs and carriage returns; empty
lines are always kept. Of equal lines the earliest stays, in the order of document id and line
number. Of lines with at least ``NEAR_LENGTH`` characters one also goes if an
earlier line is within one edit (a character replaced, inserted or deleted);
this looks at all earlier lines, kept or not.

Two lines are within one edit exactly if they have a common variant: one
character deleted from both at the same place, or one line itself and a
character deleted from the other. So all such variants are emitted as hashed
keys and equal keys are joined. Of all lines with a key only the earliest
matters, so a key's lines are never paired with each other. The edit distance of
a line and its earlier witness is then verified.

Two things keep this small and lose nothing. Within one edit, lines share
their first or their last half, so only lines whose half another line has emit
variants. And a variant's key is made of the hash of what stands before and
behind a window of ``WINDOW`` characters and the window without a character, so
a line of n characters costs about n short keys, however long it is.

Rows: a null text stays null and has no lines; a null id counts as the largest; a
row repeated with id and text is treated like the row it repeats; extra columns
are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasador.plans.lineage import cut_lineage

NEAR_LENGTH = 12
BLANKS = " \t\r"
WINDOW = 32


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by id and text; never null."""
    both = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return [F.xxhash64(*both).alias("r1"), F.xxhash64(F.lit("row"), *both[::-1]).alias("r2")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: row keys, id, n (from 0) and the trimmed line."""
    return docs.select(
        F.col(f"`{id_col}`").isNull().alias("no_id"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        *_row_keys(id_col, text_col),
        F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("n", "raw"),
    ).select("no_id", "id", "r1", "r2", "n", F.trim("raw", F.lit(BLANKS)).alias("line"))


def _place() -> Column:
    return F.struct("no_id", "id", "r1", "r2", "n")


def _half_keys(line: Column) -> list[Column]:
    """Keys of the first and last half, for the line's own length and those next to it."""
    length = F.length(line)
    halves = {"a": F.floor((length - 1) / 2), "b": F.floor((length + 1) / 2)}  # one of both is half the length
    keys = []
    for name, half in halves.items():
        half = half.cast("int")
        keys.append(F.xxhash64(F.lit("first"), half, F.substring(line, F.lit(1), half)).alias(f"f{name}"))
        keys.append(F.xxhash64(F.lit("last"), half, F.substring(line, length - half + 1, half)).alias(f"l{name}"))
    return keys


HALVES = ["fa", "la", "fb", "lb"]


def _variants(lines: DataFrame) -> DataFrame:
    """(u, key, place) of every variant of one deletion; place -1 stands for the line itself."""
    line, size = F.col("line"), F.lit(WINDOW)
    start = F.col("window") * size  # 0-based
    windows = lines.select(
        "u", "line", F.explode(F.sequence(F.lit(0), F.floor(F.length(line) / size).cast("int"))).alias("window")
    ).select(
        "u",
        "window",
        F.xxhash64(F.substring(line, F.lit(1), start)).alias("before"),
        F.substring(line, start + 1, size).alias("inside"),
        F.xxhash64(F.substring(line, start + size + 1, F.length(line))).alias("behind"),
        F.substring(line, start + 1, size - 1).alias("own"),
        F.xxhash64(F.substring(line, start + size, F.length(line))).alias("own_behind"),
    )
    inside = F.col("inside")
    deleted = F.transform(
        F.filter(F.sequence(F.lit(1), size), lambda i: i <= F.length(inside)),
        lambda i: F.struct(
            F.xxhash64(
                "window", "before", F.concat(F.substring(inside, F.lit(1), i - 1), F.substring(inside, i + 1, size)), "behind"
            ).alias("key"),
            (F.col("window") * size + i - 1).alias("place"),
        ),
    )
    itself = F.struct(F.xxhash64("window", "before", "own", "own_behind").alias("key"), F.lit(-1).alias("place"))
    return windows.select("u", F.explode(F.concat(deleted, F.array(itself))).alias("v")).select("u", "v.key", "v.place")


def _near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, near_length: int) -> DataFrame:
    """(k1, k2) of distinct lines with an earlier line within one edit."""
    long = distinct.where(F.col("length") >= near_length)
    halves = long.select("k1", "k2", F.explode(F.array(*HALVES)).alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where(F.col("a") != F.col("b"))
    asked = halves.join(cut_lineage(shared.select("half"), "halves"), "half").select("k1", "k2").distinct()
    first = long.select("k1", "k2", "first").join(asked, ["k1", "k2"])
    first = cut_lineage(first.select("k1", "k2", F.col("first.*")), "asked")

    # in order of place, so that a smaller number is an earlier line
    texts = _lines(docs, id_col, text_col).join(
        first.select("r1", "r2", "n", "k1", "k2").dropDuplicates(["r1", "r2", "n"]), ["r1", "r2", "n"]
    )
    texts = texts.dropDuplicates(["k1", "k2"]).select("k1", "k2", "line", _place().alias("place")).orderBy("place")
    texts = cut_lineage(texts.select("k1", "k2", "line", F.monotonically_increasing_id().alias("u")), "texts")

    same_key = Window.partitionBy("key")
    seen = _variants(texts).select(
        "u",
        "place",
        F.min("u").over(Window.partitionBy("key", "place")).alias("replaced"),
        F.min(F.when(F.col("place") < 0, F.col("u"))).over(same_key).alias("whole"),
        F.min(F.when(F.col("place") >= 0, F.col("u"))).over(same_key).alias("longer"),
    )
    witness = F.when(F.col("place") < 0, F.col("longer")).otherwise(F.least("replaced", "whole"))
    pairs = seen.select("u", witness.alias("w")).where(F.col("w") < F.col("u")).distinct()
    known = texts.select("k1", "k2", "line", "u")
    return (
        pairs.join(known, "u")
        .join(known.select(F.col("u").alias("w"), F.col("line").alias("earlier")), "w")
        .where(F.levenshtein("line", "earlier", 1) >= 0)
        .select("k1", "k2")
        .distinct()
    )


def line_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_length: int = NEAR_LENGTH) -> DataFrame:
    """(r1, r2, dropped) per document with a line to drop: one boolean per line, in order."""
    line = F.col("line")
    lines = _lines(docs, id_col, text_col).select(
        "no_id",
        "id",
        "r1",
        "r2",
        "n",
        F.length(line).alias("length"),
        F.xxhash64(line).alias("k1"),
        F.xxhash64(F.lit("line"), line).alias("k2"),
        *_half_keys(line),
    )
    lines = cut_lineage(lines.withColumn("blank", F.col("length") == 0), "lines")
    told = lines.where(~F.col("blank"))
    distinct = told.groupBy("k1", "k2").agg(
        F.min(_place()).alias("first"),
        F.count(F.lit(1)).alias("times"),
        F.first("length").alias("length"),
        *[F.first(h).alias(h) for h in HALVES],
    )
    distinct = cut_lineage(distinct, "distinct-lines")
    near = cut_lineage(
        _near_lines(docs, distinct, id_col, text_col, near_length).withColumn("near", F.lit(True)), "near-lines"
    )
    repeats = distinct.join(near, ["k1", "k2"], "left").where((F.col("times") > 1) | F.col("near"))
    repeats = cut_lineage(repeats.select("k1", "k2", "first", "near"), "repeats")

    later = (F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2")) | (F.col("n") != F.col("first.n"))
    dropped = told.join(repeats, ["k1", "k2"]).where(F.col("near") | later).select("r1", "r2", "n").distinct()
    dropped = cut_lineage(dropped, "dropped")
    touched = lines.join(dropped.select("r1", "r2").distinct(), ["r1", "r2"]).select("r1", "r2", "n").distinct()
    marked = touched.join(dropped.withColumn("drop", F.lit(True)), ["r1", "r2", "n"], "left")
    flags = F.sort_array(F.collect_list(F.struct("n", F.coalesce("drop", F.lit(False)).alias("drop"))))
    return marked.groupBy("r1", "r2").agg(F.transform(flags, lambda x: x["drop"]).alias("dropped"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, near_length: int) -> DataFrame:
    """``_doc`` with the new text, line counts before and after."""
    flags = cut_lineage(line_flags(docs, id_col, text_col, near_length), "flags")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_row_keys(id_col, text_col))
    rows = rows.join(flags, ["r1", "r2"], "left")
    text = F.col("_doc").getField(text_col)
    lines = F.split(text, "\n")
    told = F.zip_with(lines, "dropped", lambda a, b: F.struct(a.alias("line"), b.alias("drop")))
    kept = F.transform(F.filter(told, lambda x: ~x["drop"]), lambda x: x["line"])
    blank = F.filter(lines, lambda x: F.trim(x, F.lit(BLANKS)) != "")
    gone = F.coalesce(F.size(F.filter("dropped", lambda x: x)), F.lit(0))
    return rows.select(
        "_doc",
        F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.coalesce(F.size(blank), F.lit(0)).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """doc_id, n_lines (lines that are not empty), n_dropped and the remaining text of every document."""
    return _cleaned(docs.select("doc_id", "text"), "doc_id", "text", near_length).select(
        F.col("_doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.col("_text").alias("text")
    )


def with_text(doc: str, columns: list[str], text: Column, text_col: str = "text", length_col: str = "n_chars") -> list[Column]:
    """The columns of a packed document with a new text, and its length where there is a column for it."""
    out = []
    for c in columns:
        own = F.col(doc).getField(c)
        if c == text_col:
            own = text
        elif c == length_col:
            own = F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(own)
        out.append(own.alias(c))
    return out


def without_repeats(docs: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """The documents, all columns, without repeated lines; those left with no line at all go."""
    rows = _cleaned(docs, "doc_id", "text", near_length)
    rows = rows.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return rows.select(*with_text("_doc", docs.columns, F.col("_text")))
