"""Byte spans of a change inside a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.text import column

# Probe widths of the binary search for a common prefix: 2^30 … 1 covers any string cell.
_PROBES = "array(" + ", ".join(str(1 << b) for b in range(30, -1, -1)) + ")"


def _common_length(room: Column, same_at: Callable[[Column], Column]) -> Column:
    """Largest n <= room for which ``same_at(n)`` holds, by binary search over an expression."""
    probes = F.filter(F.expr(_PROBES), lambda p: p <= room)
    return F.aggregate(
        probes,
        F.lit(0),
        lambda found, p: F.when((found + p <= room) & same_at(found + p), found + p).otherwise(found),
    )


def change_ranges(old: Column | str, new: Column | str) -> Column:
    """Byte ranges that differ: everything between the common prefix and the common suffix.

    Gives struct(prefix, suffix, old_start, old_end, new_start, new_end); both ends are exclusive.
    """
    return _ranges(F.to_binary(column(old), F.lit("utf-8")), F.to_binary(column(new), F.lit("utf-8")))


def _ranges(a: Column, b: Column) -> Column:
    len_a, len_b = F.length(a), F.length(b)
    shorter = F.least(len_a, len_b)
    prefix = _common_length(shorter, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))

    def with_prefix(p: Column) -> Column:
        suffix = _common_length(
            shorter - p,
            lambda n: F.substring(a, len_a - n + 1, n) == F.substring(b, len_b - n + 1, n),
        )
        return F.transform(
            F.array(suffix),
            lambda s: F.struct(
                p.alias("prefix"),
                s.alias("suffix"),
                p.alias("old_start"),
                (len_a - s).alias("old_end"),
                p.alias("new_start"),
                (len_b - s).alias("new_end"),
            ),
        )[0]

    # One-element transforms bind the search results, so each search runs once per row.
    return F.transform(F.array(prefix), with_prefix)[0]


def inline_segments(old: Column | str, new: Column | str) -> Column:
    """Common prefix, deleted part, added part and common suffix of a modified line.

    Cut between characters, so that every part is valid text.
    """
    a, b = column(old), column(new)

    def cut(r: Column) -> Column:
        def text(src: Column, start: Column, end: Column) -> Column:
            return F.substring(src, start + 1, end - start)

        return F.struct(
            text(a, F.lit(0), r["prefix"]).alias("prefix"),
            text(a, r["old_start"], r["old_end"]).alias("deleted"),
            text(b, r["new_start"], r["new_end"]).alias("added"),
            text(b, r["new_end"], F.length(b)).alias("suffix"),
        )

    return F.transform(F.array(_ranges(a, b)), cut)[0]


def is_partial_change(content: Column | str, changes: Column | str) -> Column:
    """The changed tokens leave some part of the line's start or end untouched."""
    content, changes = column(content), column(changes)
    first = F.array_min(F.transform(changes, lambda c: c["start"]))
    last = F.array_max(F.transform(changes, lambda c: c["end"]))
    partial = (F.size(changes) > 0) & (content != "") & ((first > 0) | (last < F.octet_length(content)))
    return F.coalesce(partial, F.lit(False))


def effective_changes(changes: Column, start: Column, end: Column) -> Column:
    """Token changes, or one novel span over the computed range when the record carries none."""
    fallback = F.array(
        F.struct(
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            F.lit("").alias("content"),
            F.lit("novel").alias("highlight"),
        )
    )
    return (
        F.when(F.size(changes) > 0, changes)
        .when(start < end, fallback)
        .otherwise(F.filter(fallback, lambda _: F.lit(False)))
    )
