"""Changed-file listings and the contents each review mode compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import SNIFF_BYTES, column, is_binary, mapped, text_lines


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, content)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as their bytes: (path, is_binary, valid_utf8, content); binary files have no content, and what is no UTF-8 is replaced.

    Spark reads no row of an empty file.
    """
    df = spark.read.format("binaryFile").load(path)
    text = df["content"].cast("string")
    binary = F.contains(F.substring(df["content"], 1, SNIFF_BYTES), F.to_binary(F.lit("00"), F.lit("hex")))
    return df.select(
        F.regexp_replace("path", "^file:", "").alias("path"), binary.alias("is_binary"), F.is_valid_utf8(text).alias("valid_utf8"),
        F.when(~binary, F.make_valid_utf8(text)).alias("content"),
    )


def parse_listing(listing: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a name-status listing; the other columns (a mode, say) are kept.

    The first letter gives the status and lines with an unknown one are dropped. Renames and
    copies carry a similarity score and two paths.
    """
    rest = [c for c in listing.columns if c != text]
    lines = listing.select(*rest, F.explode(text_lines(text)).alias("_line"))
    status = mapped(F.substring("_line", 1, 1), schemas.LISTING_STATUS)
    two = r"^[RC]\d*[\t ]+([^\t]*)\t([^\t]*)"
    lines = lines.withColumn("status", status).filter(F.col("status").isNotNull())
    pair = F.col("status").isin("renamed", "copied")
    lines = lines.filter(~pair | F.col("_line").rlike(two))
    one = F.regexp_replace("_line", r"^.[\t ]*", "")
    return lines.select(
        *rest,
        F.when(pair, F.regexp_extract("_line", two, 2)).otherwise(one).alias("path"),
        "status",
        F.when(pair, F.regexp_extract("_line", two, 1)).alias("old_path"),
    )


def filter_paths(files: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Files whose path contains any of the arguments; no arguments keep all."""
    if not needles:
        return files
    return files.filter(F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(F.col("path"), n)))


def diff_sources(changed: DataFrame) -> DataFrame:
    """Add what the two sides of a diff are read from: nothing for new or deleted files, the old path for renames."""
    nothing = F.lit("/dev/null")
    return changed.withColumn(
        "old_source",
        F.when(F.col("status").isin("added", "untracked"), nothing).otherwise(F.coalesce("old_path", "path")),
    ).withColumn("new_source", F.when(F.col("status") == "deleted", nothing).otherwise(F.col("path")))


def revisions_of_mode(mode: Column | str, commit: Column | str) -> tuple[Column, Column]:
    """The two revisions a mode compares: HEAD and worktree, HEAD and index, or a commit's parent and the commit."""
    mode, commit = column(mode), column(commit)
    old = F.when(mode == "commit", F.concat(commit, F.lit("^"))).otherwise("HEAD")
    new = F.when(mode == "commit", commit).when(mode == "staged", "index").otherwise("worktree")
    return old, new


def mode_contents(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Add both contents of each diff (columns path, status, mode, commit) from (rev, path, content).

    An added file has no old content and a removed one no new content; a missing one reads as ''.
    """
    old, new = revisions_of_mode("mode", "commit")
    columns = diffs.columns
    rows = diffs.withColumn("_old_rev", F.when(F.col("status") != "added", old)).withColumn(
        "_new_rev", F.when(F.col("status") != "removed", new)
    )
    for side in ("old", "new"):
        stored = snapshots.select(F.col("rev").alias(f"_{side}_rev"), "path", F.col("content").alias(f"{side}_content"))
        rows = rows.join(stored, [f"_{side}_rev", "path"], "left")
    rows = rows.withColumn("old_content", F.coalesce("old_content", F.lit(""))).withColumn(
        "new_content", F.coalesce("new_content", F.lit(""))
    )
    rows = rows.withColumn("is_binary", is_binary("old_content") | is_binary("new_content"))
    return rows.select(*columns, "old_content", "new_content", "is_binary")


def content_at(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Content of each requested (rev, path), null where there is none."""
    return requests.join(snapshots.select("rev", "path", "content"), ["rev", "path"], "left")
