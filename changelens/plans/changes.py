"""Queries over entries: listing, classification and line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.operators import entries as E
from changelens.plans import relations_sql  # noqa: F401  (defines the SQL building blocks)
from changelens.plans.registry import query
from changelens.plans.revisions import files


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify(E.diff_entries(files(spark, sf_dir)))


@query(
    "reviewed_files",
    "select path, language, status, old_content, new_content from d_files",
)
def reviewed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "language", "status", "old_content", "new_content")


@query(
    "diff_entries",
    """
select path, cast(pos as bigint) pos, cast(chunk_idx as bigint) chunk_idx, cast(entry_idx as bigint) entry_idx,
  cast(entry_rank as bigint) entry_rank, cast(old_line as bigint) old_line, cast(new_line as bigint) new_line,
  old_text, new_text,
  cast(case when old_line is null or bare then 0 else 1 end as bigint) old_spans,
  cast(case when new_line is null or bare then 0 else 1 end as bigint) new_spans
from d_entries
""",
)
def diff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diff_entries(files(spark, sf_dir)).select(
        "path", "pos", "chunk_idx", "entry_idx", "entry_rank", "old_line", "new_line", "old_text", "new_text",
        F.size("old_changes").cast("bigint").alias("old_spans"),
        F.size("new_changes").cast("bigint").alias("new_spans"),
    )


@query("classify_entries", "select path, cast(pos as bigint) pos, category, same from d_entries")
def classify_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("path", "pos", "category", "same")


@query(
    "category_labels",
    "select path, cast(pos as bigint) pos, case category when 'comment' then '💬 comment' when 'whitespace' then '⎵ whitespace' else '• semantic' end label from d_entries",
)
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol and the name that each entry's category is shown with."""
    return classified(spark, sf_dir).select("path", "pos", X.category_label("category").alias("label"))


_LINE_COUNTS = """
select path,
  cast(count(*) filter (old_line is null) as bigint) lines_added,
  cast(count(*) filter (new_line is null) as bigint) lines_deleted,
  cast(count(*) filter (old_line is not null and new_line is not null) as bigint) lines_modified,
"""


@query(
    "change_summary",
    _LINE_COUNTS
    + """
  cast(count(*) filter (category = 'comment' and not same) as bigint) comment_changes,
  cast(count(*) filter (category = 'whitespace' and not same) as bigint) whitespace_changes
from d_entries group by path
""",
)
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: what changed, and how much of it is cosmetic."""
    rows = classified(spark, sf_dir)
    old, new, shown = F.col("old_line").isNotNull(), F.col("new_line").isNotNull(), ~F.col("same")
    return rows.groupBy("path").agg(
        F.count_if(new & ~old).alias("lines_added"),
        F.count_if(old & ~new).alias("lines_deleted"),
        F.count_if(old & new).alias("lines_modified"),
        F.count_if(shown & (F.col("category") == "comment")).alias("comment_changes"),
        F.count_if(shown & (F.col("category") == "whitespace")).alias("whitespace_changes"),
    )


@query("line_counts", _LINE_COUNTS.rstrip().rstrip(",") + " from d_entries group by path")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.line_counts(E.plain_entries(files(spark, sf_dir)))


@query(
    "cosmetic_counts",
    """
select path,
  cast(count(*) filter (category = 'comment') as bigint) comment_changes,
  cast(count(*) filter (category = 'whitespace') as bigint) whitespace_changes,
  cast(0 as bigint) rename_changes, cast(0 as bigint) moved_changes,
  cast(count(*) filter (category <> 'semantic') as bigint) total
from d_entries where not same group by path
""",
)
def cosmetic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cosmetic_counts(classified(spark, sf_dir))


@query(
    "chunk_bounds",
    """
select path, cast(chunk_idx as bigint) chunk_idx, cast(min(old_line) as bigint) first_old, cast(max(old_line) as bigint) last_old,
  cast(min(new_line) as bigint) first_new, cast(max(new_line) as bigint) last_new, cast(count(*) as bigint) entries
from d_entries group by path, chunk_idx
""",
)
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chunk_bounds(E.plain_entries(files(spark, sf_dir)))


@query(
    "changed_lines",
    """
select path, cast(new_line as bigint) line, arg_max(category, entry_idx) category
from d_entries where new_line is not null group by path, new_line
""",
)
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.changed_lines(E.plain_entries(files(spark, sf_dir)))
