"""Row numbers in the order of files, the same however the files are split.

A first pass counts the rows of every split (a file and the byte where its part begins) where they are read; the counts, a row a split, are summed up in order of file and byte; a second pass adds
a row's place in its split. No row moves, and no task sees more than its splits. The first rows of a table are then those with small numbers: splits beyond them are left out, and no limit gathers rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

FILE, START, ROW = "__file", "__start", "__row"


def with_places(df: DataFrame) -> DataFrame:
    """A table as read from files, with the file and the start of the split that each row is from."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START))


def numbered(df: DataFrame, name: str = "seq", first: int | None = None) -> DataFrame:
    """Rows with :func:`with_places`' columns, which go, and their numbers from 0 on; the ``first`` of them, or all.

    Rows must be as they are read: selected, exploded or filtered row by row, not moved. Files count in order of their paths.
    """
    own = df.withColumn(ROW, F.monotonically_increasing_id())
    # the hash keeps all columns in this pass, so that readers parse rows as in the next one
    values = F.max(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).alias("read")
    splits = stored(own.groupBy(FILE, START).agg(F.count("*").alias("n"), F.min(ROW).alias("least"), values).drop("read"), "splits")
    before = F.coalesce(F.sum("n").over(Window.orderBy(FILE, START).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(splits.withColumn("offset", before), "offsets", instead_of=splits)
    if first is not None:
        offsets = offsets.where(F.col("offset") < first)
    found = own.join(offsets, [FILE, START]).withColumn(name, F.col("offset") + F.col(ROW) - F.col("least"))
    if first is not None:
        found = found.where(F.col(name) < first)
    return found.select(name, *(c for c in df.columns if c not in (FILE, START)))
