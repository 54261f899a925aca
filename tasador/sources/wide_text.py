"""Separated text in two-byte encodings, read in as many tasks as it has blocks.

Lines are cut by Spark's own splittable text source at the two bytes of a line feed. A quoted
field may hold line feeds, so a line is the start of a record only if an even number
of quotes stands before it in its file. Quotes are counted per block; one number
a block is carried over, and only lines of records that span several are shuffled.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_lineage

_BLOCK = ["_file", "_block"]


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    """The first two bytes of a file, or of the first file in a folder that has any."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = files.globStatus(found) or []
    if len(listed) == 1 and listed[0].isDirectory():
        listed = sorted(files.listStatus(listed[0].getPath()), key=lambda s: s.getPath().getName())
    for status in listed:
        if status.getLen() >= 2 and status.getPath().getName()[0] not in "._":
            stream = files.open(status.getPath())
            try:
                return bytes(stream.read() for _ in range(2))
            finally:
                stream.close()
    return b""


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-16BE after the mark FE FF, else UTF-16LE."""
    return "UTF-16BE" if _first_bytes(spark, path) == b"\xfe\xff" else "UTF-16LE"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(_file, _block, _n, line, _quotes): lines in the order of ``_n`` within a block of a file."""
    raw = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    line = F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_n"),
        # a mark of the byte order is no text
        F.regexp_replace(line, "^﻿", "").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return cut_lineage(lines.withColumn("_quotes", quotes), "lines")


def text_records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(_file, _block, _n, record): one row per record of the files in ``path``, line feeds in quotes kept.

    ``_file, _block, _n`` order the records. Blank records are left out, as is a carriage return at the end.
    A quote that is never closed takes in all that follows in its file.
    """
    lines = _lines(spark, path, encoding or encoding_of(spark, path))
    blocks = lines.groupBy(*_BLOCK).agg(F.sum("_quotes").alias("_quotes"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block
    carried = blocks.select(*_BLOCK, F.coalesce(F.sum("_quotes").over(before), F.lit(0)).alias("_carry"))
    in_block = Window.partitionBy(*_BLOCK).orderBy("_n")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    lines = checked_join(lines, carried, _BLOCK)
    lines = lines.withColumn("_starts", (F.col("_carry") + F.coalesce(F.sum("_quotes").over(so_far), F.lit(0))) % 2 == 0)
    whole = F.col("_starts") & (F.col("_quotes") % 2 == 0)
    # the place of the record that a line belongs to, as far as it begins in the block
    place = F.last(F.when(F.col("_starts"), F.col("_n")), ignorenulls=True).over(in_block)
    lines = cut_lineage(lines.withColumn("_whole", whole).withColumn("_place", place), "placed")
    single = lines.where("_whole").select(*_BLOCK, "_n", F.col("line").alias("record"))
    parts = lines.where(~F.col("_whole"))
    # a record that goes on from an earlier block: the last place of the nearest one that has any
    ends = lines.groupBy(*_BLOCK).agg(F.max(F.when(F.col("_starts"), F.col("_n"))).alias("_last"))
    last = F.when(F.col("_last").isNotNull(), F.struct(F.col("_block").alias("b"), F.col("_last").alias("n")))
    ends = ends.select(*_BLOCK, F.last(last, ignorenulls=True).over(before).alias("_from"))
    parts = checked_join(parts, ends, _BLOCK)
    own = F.struct(F.col("_block").alias("b"), F.col("_place").alias("n"))
    parts = parts.withColumn("_at", F.when(F.col("_place").isNotNull(), own).otherwise(F.col("_from")))
    # one record is one row, however many lines it has
    joined = parts.groupBy("_file", "_at").agg(F.array_sort(F.collect_list(F.struct("_block", "_n", "line"))).alias("_l"))
    joined = joined.select(
        "_file",
        F.col("_at.b").alias("_block"),
        F.col("_at.n").alias("_n"),
        F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("record"),
    )
    records = single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where(F.trim("record") != "")


def read_wide_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None) -> DataFrame:
    """Text columns by header name of ``sep``-separated files in UTF-16; quotes in a field are doubled.

    All files have the header of the first one; it is the first record of each.
    """
    records = cut_lineage(text_records(spark, path, encoding), "records")
    first = records.groupBy("_file").agg(F.min(F.struct("_block", "_n")).alias("_first"))
    # one row a file
    marked = records.join(F.broadcast(first), "_file").withColumn("_header", F.struct("_block", "_n") == F.col("_first"))
    head = marked.where("_header").orderBy("_file").select("record").first()
    if head is None:
        return spark.createDataFrame([], "record string").drop("record")
    names = next(csv.reader([head["record"]], delimiter=sep))
    columns = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    options = {"sep": sep, "escape": '"', "quote": '"', "maxCharsPerColumn": "-1"}
    rows = marked.where(~F.col("_header")).select(F.from_csv("record", columns, options).alias("r"))
    return rows.select("r.*")
