"""The Markdown review report, as sorted pieces of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import line_ref, text_lines
from changelens.operators.joins import salted_lookup

FOOTER = "---\n*Generated by changelens*\n"


def comment_pieces(comments: DataFrame) -> DataFrame:
    """(path, kind, line_start, pos, text): a heading per file (kind 0) and a block per comment (kind 1).

    ``pos`` is the input position of a comment and breaks ties. Headings come from the distinct
    paths and the order from one global sort, so a file with most of the comments is no hot group.
    """
    nothing = F.lit(0).cast("bigint")
    headings = comments.select("path").distinct().select(
        "path",
        F.lit(0).alias("kind"),
        nothing.alias("line_start"),
        nothing.alias("pos"),
        F.concat(F.lit("### `"), F.col("path"), F.lit("`\n\n")).alias("text"),
    )
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    blocks = comments.select(
        "path",
        F.lit(1).alias("kind"),
        "line_start",
        F.col("pos").cast("bigint").alias("pos"),
        F.concat(
            F.lit("**"), line_ref("line_start", "line_end"), F.lit("** ("), F.col("side"), F.lit("):\n"), quoted, F.lit("\n\n")
        ).alias("text"),
    )
    return headings.unionByName(blocks)


def markdown(files: DataFrame, comments: DataFrame) -> DataFrame:
    """(section, path, kind, line_start, pos, text): the whole report; sorted by all but the text it reads as one document."""
    counts = (
        files.select(F.lit(1).alias("f"), F.lit(0).alias("c"))
        .unionByName(comments.select(F.lit(0).alias("f"), F.lit(1).alias("c")))
        .agg(F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("comments"))
    )
    head = F.format_string(
        "# Code Review\n\n## Summary\n\n- **Files reviewed:** %d\n- **Comments:** %d\n\n", "files", "comments"
    )
    some = F.col("comments") > 0
    opening = F.concat(
        head, F.when(some, "## Comments\n\n").otherwise("*No comments were added during review.*\n")
    )
    nothing = F.lit(0).cast("bigint")
    frame = counts.select(
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(0).alias("section"), opening.alias("text"), F.lit(True).alias("_on")),
                    F.struct(F.lit(2).alias("section"), F.lit(FOOTER).alias("text"), some.alias("_on")),
                ),
                lambda s: s["_on"],
            )
        )
    ).select(
        "section", F.lit("").alias("path"), F.lit(0).alias("kind"), nothing.alias("line_start"), nothing.alias("pos"), "text"
    )
    body = comment_pieces(comments).select(F.lit(1).alias("section"), "path", "kind", "line_start", "pos", "text")
    return frame.unionByName(body)


def write_markdown(report: DataFrame, out: str) -> None:
    """Write the report as text files whose order by name is the order of the document."""
    # Each piece ends in a newline and the text sink adds one, so a piece is written by its lines.
    ordered = report.orderBy("section", "path", "kind", "line_start", "pos")
    lines = F.slice(text_lines("text"), F.lit(1), F.size(text_lines("text")) - 1)
    ordered.select(F.explode(lines).alias("value")).write.mode("overwrite").text(out)


def group_headers(comments: DataFrame) -> DataFrame:
    """Comments with ``is_header``: first of its file by line and input position."""
    first = comments.groupBy("path").agg(F.min(F.struct("line_start", "pos")).alias("_first"))
    joined = salted_lookup(comments, first, ["path"], ["line_start", "pos"])
    return joined.withColumn("is_header", F.struct("line_start", "pos") == F.col("_first")).drop("_first")
