"""Collapsible regions: predicates, visibility, lookups by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import column
from changelens.operators import bitmaps as B
from changelens.operators.barrier import bind, prefix_sum
from changelens.operators.difflines import row_table, split_places, split_table
from changelens.operators.entries import is_cosmetic
from changelens.operators.joins import salted_lookup

# --- predicates of one region --------------------------------------------------------------------


def is_collapsible() -> Column:
    return F.col("end_line") > F.col("header_end_line")


def contains_body_line(line: Column | str) -> Column:
    line = column(line)
    return (line > F.col("header_end_line")) & (line <= F.col("end_line"))


def is_header_line(line: Column | str) -> Column:
    return column(line).between(F.col("start_line"), F.col("header_end_line"))


def body_line_count() -> Column:
    return F.greatest(F.col("end_line") - F.col("header_end_line"), F.lit(0).cast("bigint"))


def multi_line(regions: DataFrame) -> DataFrame:
    return regions.filter("end_line > start_line")


def with_order(df: DataFrame) -> DataFrame:
    """Add ``ordered``, the file's ``regions`` by version, start and level, parents before children."""

    def placed(r: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in ("side", "start_line", "level", "end_line")], r.alias("region"))

    return bind(df, ordered=F.transform(F.array_sort(F.transform("regions", placed)), lambda x: x["region"]))


# --- collapse state ----------------------------------------------------------------------------------


def entry_lines(entries: DataFrame) -> DataFrame:
    """(path, side, line) of both sides of every entry."""
    return entries.select(
        "path",
        F.inline(
            F.array(
                F.struct(F.lit("old").alias("side"), F.col("old_line").alias("line")),
                F.struct(F.lit("new").alias("side"), F.col("new_line").alias("line")),
            )
        ),
    ).filter("line is not null")


def uncollapse_changed(regions: DataFrame, entries: DataFrame) -> DataFrame:
    """Open every region with a changed line in its body."""
    keys = ["path", "side"]
    touched = B.line_bitmaps(entry_lines(entries), keys, "line", {"_bits": F.lit(True)})
    parts = B.spread(regions, F.col("header_end_line") + 1, F.col("end_line"), keep_empty=True)
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_cover")) != 0, F.lit(False))
    seen = parts.join(touched, [*keys, "_bucket"], "left").groupBy(*regions.columns).agg(F.max(hit).alias("_hit"))
    return seen.withColumn("collapsed", F.col("collapsed") & ~F.col("_hit")).select(*regions.columns)


def side_flags(df: DataFrame) -> DataFrame:
    """Add ``in_old`` and ``in_new``: for each of a file's ``rows``, whether its line of that side lies in a collapsed body.

    The ends of the bodies of ``regions`` and the rows, sorted by line, carry how many bodies are open.
    """
    for side in ("old", "new"):
        folded = F.filter("regions", lambda r: r["collapsed"] & (r["side"] == side) & (r["end_line"] > r["header_end_line"]))

        def event(at: Column, tie: int, n: int, i: Column) -> Column:
            parts = (at.cast("bigint").alias("at"), F.lit(tie).alias("tie"), i.cast("int").alias("i"), F.lit(n).cast("bigint").alias("n"))
            return F.struct(*parts)

        ends = F.transform(
            folded, lambda r: F.array(event(r["header_end_line"] + 1, 0, 1, F.lit(-1)), event(r["end_line"] + 1, 0, -1, F.lit(-1)))
        )
        lines = F.transform("rows", lambda x, i: event(F.coalesce(x[f"{side}_line"], F.lit(0)), 1, 0, i))
        df = bind(df, _events=F.array_sort(F.concat(F.flatten(ends), lines)))
        df = bind(df, _open=F.transform("_events", lambda e: e["n"]))
        df = bind(df, _open=prefix_sum("_open"))
        inside = F.transform("_events", lambda e, k: F.struct(e["i"].alias("i"), (F.get("_open", k) > 0).alias("inside")))
        df = bind(df, _inside=F.array_sort(F.filter(inside, lambda x: x["i"] >= 0))).drop("_events", "_open")
        df = bind(df, **{f"in_{side}": F.transform("_inside", lambda x: x["inside"])}).drop("_inside")
    return df


def with_hidden(df: DataFrame) -> DataFrame:
    """Add ``hidden``, one flag for each of a file's ``rows``, from its ``regions`` (both arrays).

    A row is hidden whose new line lies in a collapsed body of the new version, or a deletion
    whose old line lies in one of the old version.
    """
    hidden = F.transform("rows", lambda x, i: F.get("in_new", i) | (F.get("in_old", i) & (x["line_type"] == "deletion")))
    return bind(side_flags(df), hidden=hidden).drop("in_old", "in_new")


def split_with_hidden(df: DataFrame) -> DataFrame:
    """``split_places`` of a file's ``rows`` with ``hidden`` for each: the line of either side lies in a collapsed body."""
    df = split_places(side_flags(df))
    either = F.transform("split", lambda x: F.get("in_old", x["ord"].cast("int")) | F.get("in_new", x["right"]))
    return bind(df, hidden=either).drop("in_old", "in_new")


def visible_lines(df: DataFrame, folded: bool = True, drop_cosmetic: bool = False) -> DataFrame:
    """Unified rows of ``file_rows`` that stay on screen, one by one.

    ``folded`` hides what lies in a collapsed body of the file's ``regions``; ``drop_cosmetic``
    hides changed rows that are cosmetic.
    """
    rows = row_table(with_hidden(df), lambda _, i: ~F.get("hidden", i)) if folded else row_table(df)
    if drop_cosmetic:
        rows = rows.filter(~((F.col("line_type") != "context") & is_cosmetic("category")))
    return rows


def visible_split_rows(df: DataFrame, folded: bool = True, drop_cosmetic: bool = False) -> DataFrame:
    """Side-by-side rows of ``file_rows`` that stay on screen: hidden when either side is, cosmetic when both sides are."""
    df = split_with_hidden(df) if folded else split_places(df)
    if folded:
        df = bind(df, split=F.filter("split", lambda x, i: ~F.get("hidden", i)))
    rows = split_table(df)
    if drop_cosmetic:

        def quiet(side: str) -> Column:
            cell = F.col(side)
            return cell.isNull() | ((cell["line_type"] != "context") & is_cosmetic(cell["category"]))

        def unchanged(side: str) -> Column:
            return F.col(side).isNull() | (F.col(side)["line_type"] == "context")

        change = (F.col("left").isNotNull() | F.col("right").isNotNull()) & ~(unchanged("left") & unchanged("right"))
        rows = rows.filter(~(change & quiet("left") & quiet("right")))
    return rows


# --- lookups -------------------------------------------------------------------------------------------

_ABOUT = ("start_line", "end_line", "header_end_line", "node_type", "name", "collapsed", "level")


def region_at(points: DataFrame, regions: DataFrame, line: str = "line", name: str = "region") -> DataFrame:
    """First region, by start and level, that contains each row's line."""
    return B.best_interval(
        points, regions, ["path", "side"], line, F.col("start_line"), F.col("end_line"),
        [F.col("start_line"), F.col("level"), F.col("end_line")], _ABOUT, name,
    )


def header_at(points: DataFrame, regions: DataFrame, line: str = "line", name: str = "region") -> DataFrame:
    """Innermost region whose header contains each row's line, the first in order on equal levels."""
    return B.best_interval(
        points, regions, ["path", "side"], line, F.col("start_line"), F.col("header_end_line"),
        [-F.col("level"), F.col("start_line"), F.col("end_line")], _ABOUT, name,
    )


def collapsed_info(regions: DataFrame, constructs: DataFrame) -> DataFrame:
    """What stands for each collapsed body: its size, its name and how many of its lines changed.

    One row per header end line (the first region in order), 0 changes where the summary has none.
    """
    folded = regions.filter(F.col("collapsed") & is_collapsible())
    about = F.struct(body_line_count().alias("lines"), F.col("name"), F.col("node_type"))
    order = F.struct("start_line", "level", "end_line")
    first = folded.groupBy("path", "side", "header_end_line").agg(F.min_by(about, order).alias("r"))
    listed = constructs.groupBy("path", "name").agg(
        F.min_by("lines_changed", F.struct("line_start", "line_end")).alias("changes")
    )
    # Names repeat, and one may head most regions of a large file.
    rows = first.select("path", "side", "header_end_line", "r.*")
    rows = salted_lookup(rows, listed, ["path", "name"], ["side", "header_end_line"])
    return rows.withColumn("changes", F.coalesce("changes", F.lit(0).cast("bigint")))
