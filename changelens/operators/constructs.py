"""Constructs across the two versions, and the summaries built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import language_of, mapped
from changelens.operators import bitmaps as B
from changelens.operators.entries import changed_lines, file_line_counts, is_cosmetic, plain_entries
from changelens.operators.joins import salted_lookup

_PLACE = ("start_line", "level", "end_line")


def match_constructs(regions: DataFrame) -> DataFrame:
    """Constructs in both versions (modified candidates), only in the new (added), only in the old (deleted).

    Names match per file. An old name that occurs twice stands for its last region, every new
    region of a name is matched, and every old region of an unmatched name is a deletion.
    """
    top = regions.filter((F.col("level") == 1) & (F.col("name") != ""))
    old, new = F.col("side") == "old", F.col("side") == "new"
    size = F.col("end_line") - F.col("start_line")
    names = top.groupBy("path", "name").agg(
        F.max_by(F.when(old, size), F.when(old, F.struct(*_PLACE))).alias("old_size"), F.max(new).alias("_in_new")
    )
    # A file may repeat one name many times, so the join spreads the rows of a name.
    seen = salted_lookup(top, names, ["path", "name"], [*_PLACE, "side"], how="inner").filter(new | ~F.col("_in_new"))
    change = F.when(old, "deleted").when(F.col("old_size").isNull(), "added").otherwise("modified")
    return seen.select(
        "path", "name", "node_type", change.alias("change_type"),
        F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.when(new, F.col("old_size")).alias("old_size"),
    )


def lines_in_constructs(constructs: DataFrame, lines: DataFrame) -> DataFrame:
    """Add what the changed lines say about each construct.

    ``lines_changed`` distinct lines, ``all_cosmetic`` (true of no line at all) and
    ``first_cosmetic``, the category of the first cosmetic line.
    """
    sets = {"_any": F.lit(True), **{f"_{c}": F.col("category") == c for c in schemas.CATEGORIES}}
    bitmaps = B.line_bitmaps(lines, ["path"], "line", sets)
    parts = B.spread(constructs, F.col("line_start"), F.col("line_end"), keep_empty=True)
    joined = parts.join(bitmaps, ["path", "_bucket"], "left")
    zero = F.lit(0).cast("bigint")

    def inside(name: str) -> Column:
        return F.coalesce(F.col(name), zero).bitwiseAND(F.col("_cover"))

    per = joined.groupBy(*constructs.columns).agg(
        F.sum(B.count_bits(inside("_any"))).alias("lines_changed"),
        F.sum(B.count_bits(inside("_semantic"))).alias("_semantic"),
        *[F.min(B.first_line(inside(f"_{c}"), F.col("_bucket"))).alias(f"_first_{c}") for c in schemas.COSMETIC],
    )
    firsts = F.array(*[F.struct(F.col(f"_first_{c}").alias("line"), F.lit(c).alias("c")) for c in schemas.COSMETIC])
    first = F.array_min(F.filter(firsts, lambda f: f["line"].isNotNull()))["c"]
    return per.select(
        *constructs.columns,
        "lines_changed",
        (F.col("_semantic") == 0).alias("all_cosmetic"),
        first.alias("first_cosmetic"),
    )


def changed_constructs(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """The constructs that were added, deleted or modified, with their category.

    A construct in both versions counts as modified when a line in it changed or its size did.
    If all its changed lines are cosmetic it takes the first one's category, or whitespace when
    the size changed too (also when no line changed); anything else is semantic.
    """
    seen = lines_in_constructs(match_constructs(regions), lines)
    size = F.col("line_end") - F.col("line_start")
    modified = F.col("change_type") == "modified"
    resized = size != F.col("old_size")
    kept = seen.filter(~modified | (F.col("lines_changed") > 0) | resized)
    category = (
        F.when(~modified | ~F.col("all_cosmetic"), "semantic")
        .when(resized, "whitespace")
        .otherwise(F.coalesce("first_cosmetic", F.lit("semantic")))
    )
    return kept.select(
        "path", "name", "node_type", "change_type", "line_start", "line_end",
        F.when(modified, F.col("lines_changed")).otherwise(size + 1).alias("lines_changed"),
        category.alias("category"),
    )


# --- counters --------------------------------------------------------------------------------------------

CONSTRUCT_COUNTERS = [f"{b}_{t}" for b in schemas.BUCKETS for t in schemas.CHANGE_TYPES]
LINE_COUNTERS = ["lines_added", "lines_deleted", "lines_modified"]
CATEGORY_COUNTERS = ["cosmetic_changes", "semantic_changes"]
COUNTERS = CONSTRUCT_COUNTERS + LINE_COUNTERS + CATEGORY_COUNTERS


def construct_counts(constructs: DataFrame) -> DataFrame:
    """Per file: constructs by kind and change, and how many are cosmetic or semantic."""
    bucket = mapped("node_type", schemas.STAT_BUCKETS)
    rows = constructs.withColumn("_bucket", bucket)
    each = [
        F.count_if((F.col("_bucket") == b) & (F.col("change_type") == t)).alias(f"{b}_{t}")
        for b in schemas.BUCKETS
        for t in schemas.CHANGE_TYPES
    ]
    return rows.groupBy("path").agg(
        *each,
        F.count_if(is_cosmetic("category")).alias("cosmetic_changes"),
        F.count_if(~is_cosmetic("category")).alias("semantic_changes"),
    )


def _sum_of(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def with_totals(stats: DataFrame) -> DataFrame:
    """Add the derived totals of a row of counters."""
    totals = {
        f"total_{t}": _sum_of([f"{b}_{t}" for b in schemas.BUCKETS]) for t in schemas.CHANGE_TYPES
    }
    for name, value in totals.items():
        stats = stats.withColumn(name, value)
    stats = stats.withColumn("total_constructs", _sum_of(list(totals)))
    return stats.withColumn(
        "has_changes", (F.col("total_constructs") > 0) | (_sum_of(LINE_COUNTERS) > 0)
    )


def file_summary(files: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constructs, stats): the changed constructs, and one row of 23 counters per file.

    Files whose path gives no language have line counts only.
    """
    known = regions.filter(language_of("path").isNotNull())
    constructs = changed_constructs(known, changed_lines(plain_entries(files)))
    stats = (
        file_line_counts(files)
        .join(construct_counts(constructs), "path", "left")
        .na.fill(0, COUNTERS)
        .select("path", *COUNTERS)
    )
    return constructs, stats


def session_totals(stats: DataFrame) -> DataFrame:
    """One row with the sum of every counter over all files."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTERS])


def totals_by_file(stats: DataFrame) -> DataFrame:
    """Counters per file and, with a null path, over all files."""
    return stats.rollup("path").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def brief_description(stats: DataFrame) -> Column:
    """Non-zero counts in words, or the line counts when there are none."""

    def phrase(value: Column, words: str) -> Column:
        return F.when(value > 0, F.format_string(f"%d {words}", value))

    parts = [
        phrase(F.col(f"{b}_{t}"), f"{label} {t}")
        for b, label in (("functions", "fn"), ("structs", "struct"), ("tests", "test"))
        for t in schemas.CHANGE_TYPES
    ]
    other = _sum_of([f"{b}_{t}" for b in ("enums", "unions", "other") for t in schemas.CHANGE_TYPES])
    text = F.concat_ws(", ", *parts, phrase(other, "other"), phrase(F.col("cosmetic_changes"), "cosmetic"))
    lines = F.when(
        (F.col("lines_added") > 0) | (F.col("lines_deleted") > 0),
        F.format_string("+%d -%d lines", F.col("lines_added"), F.col("lines_deleted")),
    ).otherwise("no changes")
    return F.when(text == "", lines).otherwise(text)


def summary_items(constructs: DataFrame, show_cosmetic: bool = False) -> DataFrame:
    """Constructs listed in the overview."""
    return constructs if show_cosmetic else constructs.filter(~is_cosmetic("category"))


def files_with_items(files: DataFrame, constructs: DataFrame, show_cosmetic: bool = False) -> DataFrame:
    """Files that have at least one listed construct."""
    listed = summary_items(constructs, show_cosmetic).select("path").distinct()
    return files.join(listed, "path", "left_semi")
