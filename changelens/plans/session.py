"""Queries over the review session: comments, staged ranges, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.operators import session as S
from changelens.operators.scan import Fold, numbered, running
from changelens.plans.registry import cte, query
from changelens.plans.revisions import files, session, table
from changelens.sources import report as M

cte(
    "c_comments",
    """
select concat('src/', conv_id, '.', (['rs','py','js','zig','md'])[conv_id % 5 + 1]) path,
  case when role = 'user' then 'new' else 'old' end side, turn pos, turn + 1 line_start, turn + 1 + turn % 2 line_end, text
from conversations
""",
)
cte(
    "c_staged",
    """
select concat('src/', conv_id, '.', (['rs','py','js','zig','md'])[conv_id % 5 + 1]) path,
  case when role = 'user' then 'new' else 'old' end side, turn * 4 + 1 line_start, turn * 4 + 1 + length(text) % 7 line_end
from conversations
""",
)


def comments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir)[0].withColumn("pos", F.col("line_start") - 1)


def ranges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir)[1]


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, side, line) of both versions of every file."""
    counts = [F.struct(F.lit(s).alias("side"), F.size(X.text_lines(f"{s}_content")).cast("bigint").alias("n")) for s in ("old", "new")]
    sides = files(spark, sf_dir).select("path", F.inline(F.array(*counts)))
    return sides.select("path", "side", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("line"))


cte(
    "c_lines",
    """
select path, side, cast(unnest(generate_series(1, n)) as bigint) line from (
  select path, 'old' side, len(string_split(old_content, chr(10))) n from d_files
  union all select path, 'new', len(string_split(new_content, chr(10))) from d_files
)
""",
)


@query(
    "staged_semi",
    """
select l.path, l.side, l.line from c_lines l where exists (
  select 1 from c_staged s where s.path = l.path and s.side = l.side and l.line between s.line_start and s.line_end)
""",
)
def staged_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.staged_lines(numbered_lines(spark, sf_dir), ranges_of(spark, sf_dir))


@query(
    "staged_line_count",
    """
select path, cast(sum(line_end - line_start + 1) as bigint) staged_lines, cast((
  select count(distinct (t.side, l.line)) from c_staged t, unnest(generate_series(t.line_start, t.line_end)) l(line) where t.path = s.path
) as bigint) distinct_lines from c_staged s group by path
""",
)
def staged_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = ranges_of(spark, sf_dir)
    distinct = S.staged_line_count(ranges, distinct=True).withColumnRenamed("staged_lines", "distinct_lines")
    return S.staged_line_count(ranges).join(distinct, "path")


@query(
    "session_counts",
    """
select (select count(*) from documents) files, (select count(*) from c_comments) comments,
  (select cast(sum(line_end - line_start + 1) as bigint) from c_staged) staged_lines
""",
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.session_counts(docs, comments_of(spark, sf_dir), ranges_of(spark, sf_dir))


_LINE_REF = """case when line_start = line_end then concat('Line ', line_start) else concat('Lines ', line_start, '-', line_end) end"""


@query("line_ref", f"select path, pos, {_LINE_REF} line_ref from c_comments")
def line_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments_of(spark, sf_dir).select("path", "pos", X.line_ref("line_start", "line_end").alias("line_ref"))


@query(
    "sink_markdown",
    f"""
select 1 section, path, 0 kind, cast(0 as bigint) line_start, cast(0 as bigint) pos, concat('### `', path, '`', chr(10), chr(10)) text
from (select distinct path from c_comments)
union all
select 1, path, 1, line_start, pos, concat('**', {_LINE_REF}, '** (', side, '):', chr(10), '> ', replace(text, chr(10), concat(chr(10), '> ')), chr(10), chr(10))
from c_comments
union all
select 0, '', 0, 0, 0, concat('# Code Review', chr(10), chr(10), '## Summary', chr(10), chr(10), '- **Files reviewed:** ', (select count(*) from documents),
  chr(10), '- **Comments:** ', (select count(*) from conversations), chr(10), chr(10), '## Comments', chr(10), chr(10))
union all
select 2, '', 0, 0, 0, concat('---', chr(10), '*Generated by changelens*', chr(10))
""",
)
def sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return M.markdown(docs, comments_of(spark, sf_dir))


@query(
    "sorted_comments",
    """
select path, line_start, pos, row_number() over (order by path, line_start, pos) place from c_comments
""",
)
def sorted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments in report order, numbered."""
    order = ["path", "line_start", "pos"]
    return numbered(comments_of(spark, sf_dir).select(*order), order, "place")


@query(
    "group_headers",
    """
select path, line_start, pos, row_number() over (partition by path order by line_start, pos) = 1 is_header from c_comments
""",
)
def group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_headers(comments_of(spark, sf_dir)).select("path", "line_start", "pos", "is_header")


@query(
    "session_edits",
    """
select path, side, line_start, line_end from c_staged where path <> 'src/1.py'
union all select path, side, line_start + 1000, line_end + 1000 from c_staged where side = 'old' and path <> 'src/1.py'
""",
)
def session_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges appended, then those of one file dropped."""
    ranges = ranges_of(spark, sf_dir)
    more = ranges.filter("side = 'old'").withColumns(
        {"line_start": F.col("line_start") + 1000, "line_end": F.col("line_end") + 1000}
    )
    return S.clear_ranges(S.add_rows(ranges, more), "src/1.py")


@query("remove_comment", "select path, pos, line_start from c_comments where pos <> 1")
def remove_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remove_at(comments_of(spark, sf_dir), 1).select("path", "pos", "line_start")


@query(
    "cumulative_timing",
    """
select conv_id, turn, length(text) step, cast(sum(length(text)) over (partition by conv_id order by turn) as bigint) running from conversations
""",
)
def cumulative_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step sizes with their running total, as the phase report prints durations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("step"))
    return running(turns, ["conv_id"], "turn", [Fold("running", F.col("step"))])
