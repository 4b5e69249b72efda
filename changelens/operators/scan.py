"""Running computations along a position, safe for a key that holds a large share of all rows.

A plain ``Window.partitionBy(path)`` puts a whole file into one task. Here a key is cut into
blocks of consecutive positions: windows run inside a block, one total per block is carried
forward in a second, far smaller window, and the carry is joined back. The rows are shuffled
once, on (keys, block); the carry join reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK_ROWS = 65536


def whole(a: Column, n: int | Column) -> Column:
    """Integer division."""
    return F.call_function("div", a.cast("bigint"), n if isinstance(n, Column) else F.lit(n).cast("bigint"))

_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(op: str, a: Column, b: Column) -> Column:
    if op == "max":
        return F.greatest(a, b)
    if op == "min":
        return F.least(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


@dataclass(frozen=True)
class Fold:
    """A running value: ``reset`` (where not null) replaces it, then ``value`` (where not null) is folded in.

    ``backward`` runs from the last row to the first.
    """

    name: str
    value: Column
    op: str = "sum"
    reset: Column | None = None
    backward: bool = False


def last_known(name: str, value: Column) -> Fold:
    """The most recent non-null value."""
    return Fold(name, F.lit(None).cast("bigint"), "max", value)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    folds: Sequence[Fold],
    tie: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add each fold's value, its own row included, along ``pos`` (then ``tie``) within ``keys``.

    ``pos`` is a number, unique or nearly so per key.
    With ``keep_block`` the result keeps its block column, and a further scan over the same
    ``pos`` finds its rows already in place and does not shuffle them again.
    """
    blk = "_block"
    order = [F.col(pos), *map(F.col, tie)]
    rows = df if blk in df.columns else df.withColumn(blk, whole(F.col(pos), block_rows))

    def along(fold: Fold, *segment: str) -> WindowSpec:
        steps = [c.desc() for c in order] if fold.backward else order
        w = Window.partitionBy(*keys, blk, *segment).orderBy(*steps)
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    for i, fold in enumerate(folds):
        rows = rows.withColumn(f"_v{i}", fold.value)
        if fold.reset is None:
            rows = rows.withColumn(f"_t{i}", _AGGREGATE[fold.op](f"_v{i}").over(along(fold)))
            continue
        rows = rows.withColumn(f"_r{i}", fold.reset).withColumn(f"_s{i}", F.count(f"_r{i}").over(along(fold)))
        segment = along(fold, f"_s{i}")
        rows = rows.withColumn(
            f"_t{i}",
            _combine(fold.op, F.first(f"_r{i}").over(segment), _AGGREGATE[fold.op](f"_v{i}").over(segment)),
        )

    place = F.struct(*order) if tie else F.col(pos)
    totals = rows.groupBy(*keys, blk).agg(
        *[
            (F.min_by if fold.backward else F.max_by)(f"_t{i}", place).alias(f"_b{i}")
            for i, fold in enumerate(folds)
        ],
        *[
            F.max((F.col(f"_s{i}") > 0).cast("int")).alias(f"_f{i}")
            for i, fold in enumerate(folds)
            if fold.reset is not None
        ],
    )
    carry = _carry(totals, keys, blk, folds)

    out = rows.join(carry, [*keys, blk])
    made = {}
    for i, fold in enumerate(folds):
        total = _combine(fold.op, F.col(f"_c{i}"), F.col(f"_t{i}"))
        if fold.reset is not None:
            total = F.when(F.col(f"_s{i}") > 0, F.col(f"_t{i}")).otherwise(total)
        made[fold.name] = total
    kept = [c for c in df.columns if c not in {*made, blk}]
    return out.select(*kept, *[c.alias(n) for n, c in made.items()], *([blk] if keep_block else []))


def _carry(totals: DataFrame, keys: Sequence[str], blk: str, folds: Sequence[Fold]) -> DataFrame:
    """Value of each fold at the end of the block before, in its direction, of the same key."""

    def along(fold: Fold, *segment: str) -> WindowSpec:
        return Window.partitionBy(*keys, *segment).orderBy(F.col(blk).desc() if fold.backward else F.col(blk))

    def upto(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    for i, fold in enumerate(folds):
        if fold.reset is None:
            reached = _AGGREGATE[fold.op](f"_b{i}").over(upto(along(fold)))
        else:
            totals = totals.withColumn(f"_g{i}", F.sum(f"_f{i}").over(upto(along(fold))))
            reached = _AGGREGATE[fold.op](f"_b{i}").over(upto(along(fold, f"_g{i}")))
        totals = totals.withColumn(f"_e{i}", reached)
    return totals.select(
        *keys, blk, *[F.lag(f"_e{i}").over(along(fold)).alias(f"_c{i}") for i, fold in enumerate(folds)]
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: dict[str, str],
    after: dict[str, str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns of the previous (``before``) and next (``after``) row along a gap-free ``pos``.

    The first and last row of a block are also sent to the adjoining block, so each block sees
    its neighbours and no key is gathered in one task.
    """
    place = F.pmod(F.col(pos), F.lit(block_rows))
    home = whole(F.col(pos), block_rows)
    # A block of one row borders on both sides.
    homes = F.array_compact(
        F.array(home, F.when(place == 0, home - 1), F.when(place == block_rows - 1, home + 1))
    )
    rows = df.withColumn("_home", home).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    for name, source in before.items():
        rows = rows.withColumn(name, F.lag(source).over(w))
    for name, source in after.items():
        rows = rows.withColumn(name, F.lead(source).over(w))
    return rows.filter("_block = _home").drop("_block", "_home")


def stored(df: DataFrame) -> DataFrame:
    """A result that is read several times, checkpointed in the session's shared folder.

    On one machine, where spark.checkpoint.dir is unset, the folder is one beside the warehouse.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        spark.sparkContext.setCheckpointDir(folder or f"{own}/_checkpoints")
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """Add the place from 1 of every row in the order of all rows, or the sum of ``weight`` up to it.

    The rows are dealt into ranges and stored, so that the ranges hold still; each is numbered by
    itself, and the sizes of the ranges before it, one row each, are added.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    one = F.col(weight) if weight else F.lit(1)
    upto = (Window.unboundedPreceding, Window.currentRow)
    sizes = ranged.groupBy("_range").agg(F.sum(one).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(*upto)) - F.col("_n")
    inside = F.sum(one).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(*upto))
    placed = ranged.withColumn("_in", inside).join(sizes.withColumn("_before", before), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_range", "_in", "_n", "_before")
