"""Work inside a row: bind computed columns once, and running values along an array.

A file is one row (its two texts and its chunks are cells), so whatever follows the order of its
own lines or entries is computed in the row: no shuffle, and no key to be skewed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    The optimizer may otherwise inline, say, a ``split`` into a lambda and redo it per element.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    keep = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(made))


def _prefix(values: str, op: str) -> Column:
    """Running value of an associative ``op`` along the (bound) array column ``values``.

    Doubling: after the step of stride k every element covers the 2k elements up to it, so the
    cost is n log n for an array of n.
    """
    strides = ", ".join(str(1 << b) for b in range(31))
    combined = op.format(a="acc[i - k]", b="x")
    return F.expr(
        f"aggregate(filter(array({strides}), k -> k < size({values})), {values},"
        f" (acc, k) -> transform(acc, (x, i) -> if(i >= k, {combined}, x)))"
    )


def prefix_sum(values: str) -> Column:
    return _prefix(values, "{a} + {b}")


def prefix_max(values: str) -> Column:
    return _prefix(values, "greatest({a}, {b})")
