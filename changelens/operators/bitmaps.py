"""Line sets as bitmaps, and interval lookups by line bucket.

Lines are grouped into buckets of 60. A bucket of a line set is one BIGINT, so "is this line in
any range" and "how many changed lines does this construct hold" become equi joins on
(keys, bucket) with one row per bucket on the set side, combined on the map side: no range join,
no pair of rows that does not belong together, and no group that grows with a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators.scan import whole

SPAN = 60


def bucket_of(line: Column | str) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    return whole(line, SPAN)


def _shift(bits: Column, by: Column) -> Column:
    # The Python function takes only a literal shift.
    return F.call_function("shiftleft", bits, by)


def _bit(line: Column) -> Column:
    return _shift(F.lit(1).cast("bigint"), F.pmod(line, F.lit(SPAN)).cast("int"))


def _low_bits(count: Column) -> Column:
    return _shift(F.lit(1).cast("bigint"), count.cast("int")) - 1


def spread(df: DataFrame, low: Column, high: Column, keep_empty: bool = False) -> DataFrame:
    """One row per bucket a closed range touches: ``_bucket``, ``_low``, ``_high`` (clipped) and ``_cover`` (bitmap).

    An empty range has no row, or one with an empty cover if ``keep_empty``.
    """
    rows = df.withColumn("_from", low.cast("bigint")).withColumn("_to", high.cast("bigint"))
    empty = F.col("_from") > F.col("_to")
    if not keep_empty:
        rows = rows.filter(~empty)
    last = F.greatest(bucket_of("_to"), bucket_of("_from"))
    rows = rows.withColumn("_bucket", F.explode(F.sequence(bucket_of("_from"), last)))
    rows = rows.withColumn("_low", F.greatest("_from", F.col("_bucket") * SPAN)).withColumn(
        "_high", F.least("_to", F.col("_bucket") * SPAN + (SPAN - 1))
    )
    cover = _shift(
        _low_bits(F.greatest(F.col("_high") - F.col("_low") + 1, F.lit(0).cast("bigint"))),
        F.pmod(F.col("_low"), F.lit(SPAN)).cast("int"),
    )
    return rows.withColumn("_cover", cover).drop("_from", "_to")


def range_bitmap(ranges: DataFrame, keys: Sequence[str], low: Column, high: Column, name: str) -> DataFrame:
    """The lines covered by any of the ranges: (keys, _bucket, name)."""
    return spread(ranges, low, high).groupBy(*keys, "_bucket").agg(F.bit_or("_cover").alias(name))


def line_bitmaps(lines: DataFrame, keys: Sequence[str], line: str, sets: dict[str, Column]) -> DataFrame:
    """One bitmap column per named condition on a line relation."""
    nothing = F.lit(0).cast("bigint")
    return (
        lines.withColumn("_bucket", bucket_of(line))
        .groupBy(*keys, "_bucket")
        .agg(
            *[
                F.bit_or(F.when(condition, _bit(F.col(line))).otherwise(nothing)).alias(name)
                for name, condition in sets.items()
            ]
        )
    )


def flag_lines(points: DataFrame, bitmap: DataFrame, keys: Sequence[str], line: str, name: str) -> DataFrame:
    """Replace the bitmap by a boolean per row: is the row's line in the set (null lines are not)."""
    hit = F.coalesce(F.col(name).bitwiseAND(_bit(F.col(line))) != 0, F.lit(False))
    joined = points.withColumn("_bucket", bucket_of(line)).join(bitmap, [*keys, "_bucket"], "left")
    return joined.withColumn(name, hit).select(*[c for c in points.columns if c != name], name)


def count_bits(bits: Column) -> Column:
    return F.bit_count(bits).cast("bigint")


def first_line(bits: Column, bucket: Column) -> Column:
    """Smallest line of a bitmap bucket, null when it is empty."""
    lowest = F.bit_count(bits.bitwiseAND(-bits) - 1)
    return F.when(bits != 0, bucket * SPAN + lowest)


def best_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    line: str,
    low: Column,
    high: Column,
    rank: Sequence[Column],
    keep: Sequence[str],
    name: str,
) -> DataFrame:
    """Add the best interval (smallest ``rank``) that contains each row's line, as a struct of ``keep``, else null.

    Intervals are clipped to buckets and reduced to the best one per clipped range, so a bucket
    holds at most 60*61/2 candidates however many intervals overlap; each row meets one list.
    """
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *[F.col(c) for c in keep])
    lists = (
        spread(intervals.withColumn("_best", best), low, high)
        .groupBy(*keys, "_bucket", "_low", "_high")
        .agg(F.min("_best").alias("_best"))
        .groupBy(*keys, "_bucket")
        .agg(F.collect_list(F.struct("_low", "_high", "_best")).alias("_list"))
    )
    joined = points.withColumn("_bucket", bucket_of(line)).join(lists, [*keys, "_bucket"], "left")
    inside = F.filter("_list", lambda i: F.col(line).between(i["_low"], i["_high"]))
    picked = F.array_min(F.transform(inside, lambda i: i["_best"]))
    result = F.when(picked.isNotNull(), F.struct(*[picked[c].alias(c) for c in keep]))
    return joined.withColumn(name, result).select(*points.columns, name)
