"""Queries over regions, constructs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.operators import constructs as C
from changelens.operators import entries as E
from changelens.operators import regions as R
from changelens.operators import summary as S
from changelens.plans.registry import query
from changelens.plans.relations_sql import ALL_COUNTERS
from changelens.plans.revisions import files, line_regions, with_line_regions


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_regions(files(spark, sf_dir))


def constructs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changed_constructs(with_line_regions(files(spark, sf_dir)))


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_summary(with_line_regions(files(spark, sf_dir)))


_REGION = (
    "path, side, cast(start_line as bigint) start_line, cast(end_line as bigint) end_line, "
    "cast(header_end_line as bigint) header_end_line, node_type, name, collapsed, cast(level as bigint) level"
)


@query("line_regions", f"select {_REGION} from d_regions")
def all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions_of(spark, sf_dir)


@query(
    "region_order",
    """
select path, side, cast(row_number() over (partition by path order by side, start_line, level, end_line) - 1 as bigint) nth,
  cast(start_line as bigint) start_line, cast(level as bigint) level from d_regions
""",
)
def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each region in its file."""
    rows = R.with_order(with_line_regions(files(spark, sf_dir))).select("path", F.posexplode("ordered").alias("nth", "r"))
    return rows.select("path", "r.side", F.col("nth").cast("bigint").alias("nth"), "r.start_line", "r.level")


@query(
    "region_predicates",
    """
select path, side, cast(start_line as bigint) start_line, end_line > header_end_line collapsible,
  cast(greatest(end_line - header_end_line, 0) as bigint) body_lines,
  start_line + 2 > header_end_line and start_line + 2 <= end_line third_in_body,
  start_line between start_line and header_end_line first_in_header
from d_regions where end_line > start_line
""",
)
def region_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multi_line(regions_of(spark, sf_dir)).select(
        "path", "side", "start_line",
        R.is_collapsible().alias("collapsible"),
        R.body_line_count().alias("body_lines"),
        R.contains_body_line(F.col("start_line") + 2).alias("third_in_body"),
        R.is_header_line("start_line").alias("first_in_header"),
    )


@query(
    "uncollapse",
    """
select r.path, r.side, cast(r.start_line as bigint) start_line,
  r.collapsed and not exists (
    select 1 from d_entries e where e.path = r.path
      and case r.side when 'old' then e.old_line else e.new_line end > r.header_end_line
      and case r.side when 'old' then e.old_line else e.new_line end <= r.end_line) collapsed
from d_regions r
""",
)
def uncollapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = files(spark, sf_dir)
    opened = R.uncollapse_changed(line_regions(pairs), E.plain_entries(pairs))
    return opened.select("path", "side", "start_line", "collapsed")


@query(
    "match_constructs",
    """
select path, name, node_type, change_type, cast(line_start as bigint) line_start, cast(line_end as bigint) line_end,
  cast(old_size as bigint) old_size from d_matched
""",
)
def match_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_constructs(regions_of(spark, sf_dir))


@query(
    "lines_in_construct",
    """
select path, name, change_type, cast(line_start as bigint) line_start, cast(changes as bigint) lines_changed,
  all_cosmetic, first_cosmetic from d_construct_lines
""",
)
def lines_in_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = files(spark, sf_dir)
    lines = E.changed_lines(E.plain_entries(pairs))
    seen = C.lines_in_constructs(C.match_constructs(line_regions(pairs)), lines)
    return seen.select("path", "name", "change_type", "line_start", "lines_changed", "all_cosmetic", "first_cosmetic")


@query("changed_constructs", "select * from d_constructs")
def changed_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constructs_of(spark, sf_dir)


@query(
    "construct_pivot",
    "select path, " + ", ".join(f"cast({c} as bigint) {c}" for c in ALL_COUNTERS if not c.startswith("lines_"))
    + " from d_construct_counts",
)
def construct_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = constructs_of(spark, sf_dir).filter(X.language_of("path").isNotNull())
    return C.construct_counts(known)


@query("file_summary", "select * from d_stats")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir)


@query(
    "session_totals",
    "select " + ", ".join(f"cast(sum({c}) as bigint) {c}" for c in ALL_COUNTERS) + " from d_stats",
)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.session_totals(stats_of(spark, sf_dir))


@query(
    "totals_by_file",
    "select path, " + ", ".join(f"cast(sum({c}) as bigint) {c}" for c in ALL_COUNTERS) + " from d_stats group by rollup (path)",
)
def totals_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.totals_by_file(stats_of(spark, sf_dir))


_SUMS = {
    t: " + ".join(f"{b}_{t}" for b in ("functions", "structs", "enums", "unions", "tests", "other"))
    for t in ("added", "modified", "deleted")
}


@query(
    "file_totals",
    "select path, "
    + ", ".join(f"cast({e} as bigint) total_{t}" for t, e in _SUMS.items())
    + f", cast({' + '.join(_SUMS.values())} as bigint) total_constructs, "
    + f"({' + '.join(_SUMS.values())}) > 0 or lines_added + lines_deleted + lines_modified > 0 has_changes from d_stats",
)
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_totals(stats_of(spark, sf_dir)).select(
        "path", "total_added", "total_modified", "total_deleted", "total_constructs", "has_changes"
    )


_PHRASES = ", ".join(
    f"case when {b}_{t} > 0 then concat({b}_{t}, ' {label} {t}') end"
    for b, label in (("functions", "fn"), ("structs", "struct"), ("tests", "test"))
    for t in ("added", "modified", "deleted")
)
_OTHER = " + ".join(f"{b}_{t}" for b in ("enums", "unions", "other") for t in ("added", "modified", "deleted"))


@query(
    "brief_description",
    f"""
select path, case when brief <> '' then brief when lines_added > 0 or lines_deleted > 0
  then concat('+', lines_added, ' -', lines_deleted, ' lines') else 'no changes' end brief
from (select *, concat_ws(', ', {_PHRASES}, case when {_OTHER} > 0 then concat({_OTHER}, ' other') end,
  case when cosmetic_changes > 0 then concat(cosmetic_changes, ' cosmetic') end) brief from d_stats)
""",
)
def brief_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stats_of(spark, sf_dir)
    return stats.select("path", C.brief_description(stats).alias("brief"))


@query(
    "line_change_summary",
    "select concat('+', sum(lines_added), ' -', sum(lines_deleted)) summary from d_stats",
)
def line_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = C.session_totals(stats_of(spark, sf_dir))
    return totals.select(X.line_change_summary("lines_added", "lines_deleted").alias("summary"))


@query(
    "summary_items",
    """
select path, cast(line_start as bigint) line_start,
  concat(case change_type when 'added' then '+' when 'modified' then '~' else '-' end, ' ', name, ' (',
    case when change_type = 'modified' then 'modified' else
      case node_type when 'function' then 'fn' when 'struct_' then 'struct' when 'enum_' then 'enum' when 'union_' then 'union'
        when 'test_decl' then 'test' else node_type end end, ')') item
from d_constructs where category = 'semantic'
""",
)
def summary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.summary_items(constructs_of(spark, sf_dir))
    return items.select(
        "path", "line_start", X.construct_description("change_type", "name", "node_type").alias("item")
    )


_ITEMS = """
select *, row_number() over (order by path, line_start, change_type, name) - 1 place, row_number() over (partition by path order by line_start, change_type, name) - 1 nth
from d_constructs where category = 'semantic'
"""


@query("item_count", f"select cast(count(*) as bigint) items, cast(count(distinct path) as bigint) files from ({_ITEMS})")
def item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many constructs the overview lists, and in how many files."""
    rows = S.with_items(with_line_regions(files(spark, sf_dir)))
    return rows.agg(F.sum(F.size("items")).alias("items"), F.count_if(F.size("items") > 0).alias("files"))


@query(
    "kth_items",
    f"select cast(place as bigint) place, path, cast(nth as bigint) nth, name, change_type, cast(line_start as bigint) line_start from ({_ITEMS}) where place % 3 = 0",
)
def kth_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item of the overview, found by its place."""
    rows = S.with_items(with_line_regions(files(spark, sf_dir)))
    total = rows.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n"))
    asked = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(3).cast("bigint"))).alias("place"))
    found = S.items_at(rows, asked)
    return found.select("place", "path", "nth", "construct.name", "construct.change_type", "construct.line_start")


@query(
    "item_order",
    f"select path, cast(nth as bigint) nth, name, change_type, cast(line_start as bigint) line_start from ({_ITEMS})",
)
def item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each listed construct in its file."""
    rows = S.with_items(with_line_regions(files(spark, sf_dir))).select("path", F.posexplode("items").alias("nth", "c"))
    return rows.select("path", F.col("nth").cast("bigint").alias("nth"), "c.name", "c.change_type", "c.line_start")


@query(
    "files_with_items",
    "select path from d_docs d where exists (select 1 from d_constructs c where c.path = d.path and c.category = 'semantic')",
)
def files_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = S.with_items(with_line_regions(files(spark, sf_dir)))
    return items.filter(F.size("items") > 0).select("path")


@query(
    "collapsed_info",
    """
select r.path, r.side, cast(r.header_end_line as bigint) header_end_line, r.name, r.node_type,
  cast(r.end_line - r.header_end_line as bigint) lines,
  coalesce((select arg_min(c.lines_changed, c.line_start * 1000000 + c.line_end) from d_constructs c where c.path = r.path and c.name = r.name), 0) changes
from d_regions r where r.collapsed and r.end_line > r.header_end_line
""",
)
def collapsed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collapsed_info(regions_of(spark, sf_dir), constructs_of(spark, sf_dir))
