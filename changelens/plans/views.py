"""Queries over the unified and side-by-side rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.functions.spans import change_ranges
from changelens.functions.spans import inline_segments as inline
from changelens.operators import difflines as D
from changelens.operators import navigation as N
from changelens.operators import regions as R
from changelens.operators.session import side_label
from changelens.plans.registry import cte, query
from changelens.plans.revisions import files, line_regions, with_line_regions
from changelens.plans.session import numbered_lines


@query(
    "diff_lines",
    """
select path, cast(ord as bigint) ord, line_type, old_line, new_line, content, old_content, category, selectable from d_diff_lines
""",
)
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_lines(files(spark, sf_dir)).select(
        "path", "ord", "line_type", "old_line", "new_line", "content", "old_content", "category", "selectable"
    )


@query(
    "line_offset",
    """
select path, cast(ord as bigint) ord, cast(new_line - old_line as bigint) line_offset
from d_diff_lines where line_type = 'context' and selectable
""",
)
def line_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running old/new shift seen at every context line."""
    rows = D.diff_lines(files(spark, sf_dir)).filter("line_type = 'context' and selectable")
    return rows.select("path", "ord", (F.col("new_line") - F.col("old_line")).alias("line_offset"))


@query("separators", "select path, cast(ord as bigint) ord from d_diff_lines where not selectable")
def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_lines(files(spark, sf_dir)).filter("not selectable").select("path", "ord")


cte(
    "d_split",
    """
select * from (
  select *, lead(line_type) over w next_type, lead(new_line) over w next_line, lead(content) over w next_content,
    lead(category) over w next_category, lag(line_type) over w prev_type
  from d_diff_lines window w as (partition by path order by ord)
) where not (line_type = 'addition' and coalesce(prev_type = 'deletion', false))
""",
)
cte(
    "d_split_rows",
    """
select path, cast(ord as bigint) ord,
  case when line_type = 'addition' or coalesce(old_line, 0) = 0 then null else old_line end left_line,
  case when line_type = 'addition' or coalesce(old_line, 0) = 0 then null
       when line_type = 'modification' then old_content else content end left_content,
  case when line_type = 'addition' or coalesce(old_line, 0) = 0 then null
       when line_type = 'modification' then 'deletion' else line_type end left_type,
  case when line_type = 'addition' or coalesce(old_line, 0) = 0 then null else category end left_category,
  case when line_type = 'deletion' then case when next_type = 'addition' then next_line end else nullif(new_line, 0) end right_line,
  case when line_type = 'deletion' then case when next_type = 'addition' then next_content end
       when coalesce(new_line, 0) > 0 then content end right_content,
  case when line_type = 'deletion' then case when next_type = 'addition' then next_type end
       when coalesce(new_line, 0) > 0 then case when line_type = 'context' then 'context' else 'addition' end end right_type,
  case when line_type = 'deletion' then case when next_type = 'addition' then next_category end
       when coalesce(new_line, 0) > 0 then category end right_category,
  selectable
from d_split
""",
)


@query("split_rows", "select * from d_split_rows")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.split_rows(files(spark, sf_dir))
    return rows.select(
        "path", "ord",
        F.col("left.line").alias("left_line"), F.col("left.content").alias("left_content"),
        F.col("left.line_type").alias("left_type"), F.col("left.category").alias("left_category"),
        F.col("right.line").alias("right_line"), F.col("right.content").alias("right_content"),
        F.col("right.line_type").alias("right_type"), F.col("right.category").alias("right_category"),
        "selectable",
    )


@query(
    "side_labels",
    """
select path, ord, case when left_line is not null then 'old' when right_line is not null then 'new' end old_focus,
  case when right_line is not null then 'new' when left_line is not null then 'old' end new_focus from d_split_rows
""",
)
def side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a comment on a side-by-side row belongs to, by which side has the focus."""
    left, right = F.col("left.line"), F.col("right.line")
    labels = {f"{focus}_focus": side_label(right, focus, left) for focus in ("old", "new")}
    return D.split_rows(files(spark, sf_dir)).withColumns(labels).select("path", "ord", *labels)


@query(
    "line_offsets",
    """
select path, line, content, cast(sum(strlen(content) + 1) over (partition by path order by line) - strlen(content) - 1 as bigint) byte_offset
from (
  select path, cast(generate_subscripts(s, 1) as bigint) line, unnest(s) content
  from (select path, string_split(new_content, chr(10)) s from d_files)
)
""",
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_offsets(files(spark, sf_dir), "new")


# --- visibility ---------------------------------------------------------------------------------------

cte(
    "d_flagged",
    """
select l.*, not exists (
    select 1 from d_regions r where r.path = l.path and r.collapsed and (
      (r.side = 'new' and l.new_line > r.header_end_line and l.new_line <= r.end_line)
      or (r.side = 'old' and l.line_type = 'deletion' and l.old_line > r.header_end_line and l.old_line <= r.end_line))
  ) visible
from d_diff_lines l
""",
)


def viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and the regions of each file, both in its row."""
    return D.file_rows(with_line_regions(files(spark, sf_dir)), keep=["regions"])


@query("row_flags", "select path, cast(ord as bigint) ord, visible, visible and selectable navigable from d_flagged")
def row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.flag_rows(viewed(spark, sf_dir))


@query("hidden_semi", "select path, cast(ord as bigint) ord from d_flagged where not visible")
def hidden_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.flag_rows(viewed(spark, sf_dir)).filter("not visible").select("path", "ord")


@query(
    "visible_lines",
    "select path, cast(ord as bigint) ord, line_type, category from d_flagged where visible and not (line_type <> 'context' and category <> 'semantic')",
)
def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = R.visible_lines(viewed(spark, sf_dir), folded=True, drop_cosmetic=True)
    return shown.select("path", "ord", "line_type", "category")


@query(
    "visible_split",
    """
select path, ord from d_split_rows s
where not exists (select 1 from d_regions r where r.path = s.path and r.collapsed and (
    (r.side = 'old' and s.left_line > r.header_end_line and s.left_line <= r.end_line)
    or (r.side = 'new' and s.right_line > r.header_end_line and s.right_line <= r.end_line)))
  and not ((left_line is not null or right_line is not null)
    and not ((left_line is null or left_type = 'context') and (right_line is null or right_type = 'context'))
    and (left_line is null or (left_type <> 'context' and left_category <> 'semantic'))
    and (right_line is null or (right_type <> 'context' and right_category <> 'semantic')))
""",
)
def visible_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.visible_split_rows(viewed(spark, sf_dir), folded=True, drop_cosmetic=True).select("path", "ord")


@query(
    "split_row_flags",
    """
select path, ord, visible, visible and selectable navigable from (
  select s.*, not exists (select 1 from d_regions r where r.path = s.path and r.collapsed and (
    (r.side = 'old' and s.left_line > r.header_end_line and s.left_line <= r.end_line)
    or (r.side = 'new' and s.right_line > r.header_end_line and s.right_line <= r.end_line))) visible
  from d_split_rows s
)
""",
)
def split_row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible and navigable side-by-side rows."""
    return N.split_flag_rows(viewed(spark, sf_dir))


@query(
    "nearest_navigable",
    """
select path, cast(ord as bigint) ord, cast(case when visible then ord else coalesce(
  max(case when visible and selectable then ord end) over (partition by path order by ord),
  min(case when visible and selectable then ord end) over (partition by path order by ord desc), 0) end as bigint) cursor
from d_flagged
""",
)
def nearest_navigable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nearest_navigable(viewed(spark, sf_dir))


@query(
    "scroll_to_line",
    """
select t.path, cast(t.line as bigint) line, (select min(ord) from d_diff_lines l where l.path = t.path and l.new_line >= t.line) ord
from (select path, unnest([1, 12, 30, 90]) line from d_docs) t
""",
)
def scroll_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = files(spark, sf_dir)
    targets = pairs.select("path", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 12, 30, 90)])).alias("line"))
    return N.scroll_to_line(D.diff_lines(pairs), targets)


_VIEWED = "src/0.rs"


@query(
    "viewport",
    f"select ord, line_type, content from d_diff_lines where path = '{_VIEWED}' order by ord offset 2 limit 4",
)
def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.diff_lines(files(spark, sf_dir))
    return N.viewport(rows, _VIEWED, 2, 4).select("ord", "line_type", "content")


@query(
    "viewports",
    """
select path, cast(shown_at as bigint) shown_at, cast(ord as bigint) ord from (
  select *, row_number() over (partition by path order by ord) - 1 shown_at from d_flagged where visible
) where shown_at between 3 and 9
""",
)
def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven visible rows of every file after the first three."""
    return N.viewports(viewed(spark, sf_dir), 3, 7)


@query(
    "page_move",
    """
select path, cast(ord as bigint) ord, least(ord + 20, last) down, greatest(ord - 20, 0) up
from (select path, ord, max(ord) over (partition by path) last from d_diff_lines)
""",
)
def page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.diff_lines(files(spark, sf_dir)).select("path", "ord")
    ends = rows.groupBy("path").agg(F.max("ord").alias("last"))
    cursor, last = F.col("ord"), F.col("last")
    return rows.join(ends, "path").select(
        "path", "ord",
        N.page_move(cursor, last).alias("down"),
        N.page_move(cursor, last, down=False).alias("up"),
    )


_EXCERPT = """
select path, string_agg(concat(case line_type when 'addition' then '+' when 'deletion' then '-' when 'modification' then '~' else ' ' end, ' ',
    case when line_type = 'modification' then concat(old_content, ' → ') else '' end, content, chr(10)), '' order by ord) code
from d_diff_lines where coalesce(new_line, old_line) between 4 and 9 group by path
"""


@query("select_range", f"select path, cast(0 as bigint) part, code from ({_EXCERPT})")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.excerpt(D.diff_lines(files(spark, sf_dir)), F.lit(4), F.lit(9))


@query(
    "ask_prompt",
    f"""
select path, cast(0 as bigint) part, concat('Review of demo, ', path, ', lines 4-9', chr(10), '```', chr(10), code,
  '```', chr(10), chr(10), 'why?', chr(10), chr(10), 'Keep the answer short.') prompt from ({_EXCERPT})
""",
)
def ask_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = N.excerpt(D.diff_lines(files(spark, sf_dir)), F.lit(4), F.lit(9))
    code = code.withColumn("last", F.max("part").over(Window.partitionBy("path")))
    first, last = F.col("part") == 0, F.col("part") == F.col("last")
    prompt = X.ask_prompt(F.lit("demo"), F.col("path"), F.lit(4), F.lit(9), F.col("code"), F.lit("why?"), first, last)
    return code.select("path", "part", prompt.alias("prompt"))


_FOUND = "cast(start_line as bigint) start_line, cast(level as bigint) level, name"


@query(
    "find_region_for_line",
    f"""
select path, line, {_FOUND} from (
  select l.path, l.line, r.start_line, r.level, r.name, row_number() over (partition by l.path, l.line order by r.start_line, r.level) k
  from c_lines l left join d_regions r on r.path = l.path and r.side = 'new' and l.line between r.start_line and r.end_line
  where l.side = 'new'
) where k = 1
""",
)
def find_region_for_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = line_regions(files(spark, sf_dir))
    lines = numbered_lines(spark, sf_dir).filter("side = 'new'")
    return R.region_at(lines, regions).select("path", "line", "region.start_line", "region.level", "region.name")


@query(
    "innermost_header",
    f"""
select path, line, {_FOUND} from (
  select l.path, l.line, r.start_line, r.level, r.name, row_number() over (partition by l.path, l.line order by r.level desc, r.start_line) k
  from c_lines l left join (
    select path, start_line, header_end_line + 6 header_end_line, level, name from d_regions where side = 'old') r
    on r.path = l.path and l.line between r.start_line and r.header_end_line
  where l.side = 'old'
) where k = 1
""",
)
def innermost_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers are stretched by six lines here, so that several cover a line."""
    regions = line_regions(files(spark, sf_dir)).withColumn("header_end_line", F.col("header_end_line") + 6)
    lines = numbered_lines(spark, sf_dir).filter("side = 'old'")
    return R.header_at(lines, regions).select("path", "line", "region.start_line", "region.level", "region.name")


@query(
    "inline_segments",
    """
select path, pos, m.prefix, x.old_content[m.p + 1:length(x.old_content) - m.s] deleted, x.content[m.p + 1:length(x.content) - m.s] added, m.suffix from (
  select path, cast(ord as bigint) pos, old_content, content, p, old_content[1:p] prefix, s, right(content, s) suffix from (
    select *, list_max(list_filter(generate_series(0, least(length(old_content), length(content)) - p), lambda k: right(old_content, k) = right(content, k))) s
    from (
      select *, list_max(list_filter(generate_series(0, least(length(old_content), length(content))), lambda k: old_content[1:k] = content[1:k])) p
      from d_diff_lines where line_type = 'modification'
    )
  )
) m join d_diff_lines x using (path) where x.ord = m.pos
""",
)
def inline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.diff_lines(files(spark, sf_dir)).filter("line_type = 'modification'")
    cut = rows.select("path", F.col("ord").alias("pos"), inline("old_content", "content").alias("s"))
    return cut.select("path", "pos", "s.*")


@query(
    "change_range",
    """
select path, cast(ord as bigint) ord, cast(p as bigint) start, cast(len(a) - s as bigint) old_end, cast(len(b) - s as bigint) new_end from (
  select *, list_max(list_filter(generate_series(0, least(len(a), len(b)) - p), lambda k: k = 0 or a[len(a) - k + 1:] = b[len(b) - k + 1:])) s
  from (
    select *, list_max(list_filter(generate_series(0, least(len(a), len(b))), lambda k: a[1:k] = b[1:k])) p
    from (
      select path, ord, regexp_extract_all(hex(encode(old_content)), '..') a, regexp_extract_all(hex(encode(content)), '..') b
      from d_diff_lines where line_type = 'modification' and bare
    )
  )
)
""",
)
def change_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte spans computed for modified pairs whose record carries no token spans."""
    rows = D.diff_lines(files(spark, sf_dir)).filter("line_type = 'modification' and get(changes, 0).content = '' and get(changes, 0).end > 0")
    ranges = change_ranges("old_content", "content")
    return rows.select("path", "ord", ranges.alias("r")).select(
        "path", "ord",
        F.col("r.old_start").cast("bigint").alias("start"),
        F.col("r.old_end").cast("bigint").alias("old_end"),
        F.col("r.new_end").cast("bigint").alias("new_end"),
    )
