"""Review session: comments and staged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators import bitmaps as B


def add_rows(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Append files, comments or ranges."""
    return existing.unionByName(more)


def remove_at(rows: DataFrame, position: int, order: str = "pos") -> DataFrame:
    """Drop the row at a position."""
    return rows.filter(F.col(order) != position)


def clear_ranges(ranges: DataFrame, path: str | None = None) -> DataFrame:
    """Drop the staged ranges of one file, or all of them."""
    return ranges.limit(0) if path is None else ranges.filter(F.col("path") != path)


def staged_bitmap(ranges: DataFrame) -> DataFrame:
    return B.range_bitmap(ranges, ["path", "side"], F.col("line_start"), F.col("line_end"), "staged")


def flag_staged(lines: DataFrame, ranges: DataFrame, line: str = "line") -> DataFrame:
    """Add ``staged``: does any range of the line's file and side contain it. Ranges may overlap."""
    return B.flag_lines(lines, staged_bitmap(ranges), ["path", "side"], line, "staged")


def staged_lines(lines: DataFrame, ranges: DataFrame, line: str = "line") -> DataFrame:
    return flag_staged(lines, ranges, line).filter("staged").drop("staged")


def staged_line_count(ranges: DataFrame, distinct: bool = False) -> DataFrame:
    """Staged lines per file. A line in two ranges counts twice unless ``distinct``."""
    if distinct:
        bits = staged_bitmap(ranges)
        return bits.groupBy("path").agg(F.sum(B.count_bits(F.col("staged"))).alias("staged_lines"))
    return ranges.groupBy("path").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("staged_lines"))


def session_counts(files: DataFrame, comments: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: files, comments, staged lines."""
    size = (F.col("line_end") - F.col("line_start") + 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    parts = (
        files.select(F.lit("f").alias("k"), zero.alias("n"))
        .unionByName(comments.select(F.lit("c").alias("k"), zero.alias("n")))
        .unionByName(ranges.select(F.lit("s").alias("k"), size.alias("n")))
    )
    return parts.agg(
        F.count_if(F.col("k") == "f").alias("files"),
        F.count_if(F.col("k") == "c").alias("comments"),
        F.coalesce(F.sum("n"), zero).alias("staged_lines"),
    )


def side_label(new_line: Column, focus: str | None = None, old_line: Column | None = None) -> Column:
    """Side a comment on a row belongs to: the focused side if it has the line, else new before old."""
    old = F.when(F.lit(True) if old_line is None else old_line.isNotNull(), "old")
    new = F.when(new_line.isNotNull(), "new")
    return F.coalesce(old, new) if focus == "old" else F.coalesce(new, old)
