"""Joins against a side that is unique per key, and ordered text assembly, both safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators.scan import Fold, running, whole

SALTS = 16
PART_BYTES = 16 * 1024 * 1024


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows that may pile up on one key to a lookup with one row per key.

    A key's rows are spread over ``salts`` partitions by ``spread_by`` and the lookup row is
    repeated for each, so that no task gets a whole hot key.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def ordered_concat(
    rows: DataFrame,
    keys: Sequence[str],
    pos: str,
    text: Column,
    name: str,
    part_bytes: int = PART_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """Concatenate ``text`` along ``pos`` per key, as numbered parts of bounded size: (keys, part, name).

    A text up to ``part_bytes`` is one row (part 0). A longer one continues in parts 1, 2, …, so
    nothing is cut off and no group outgrows a task.
    """
    sized = rows.withColumn("_text", text).filter(F.col("_text").isNotNull())
    more = {} if block_rows is None else {"block_rows": block_rows}
    # The extra byte per piece bounds the number of pieces in a part even when they are empty.
    size = (F.octet_length("_text") + 1).cast("bigint")
    placed = running(sized, keys, pos, [Fold("_upto", size)], **more)
    part = whole(F.col("_upto") - 1, part_bytes)
    pieces = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_text").alias("t"))))
    return (
        placed.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias(name))
    )
