"""The derived relations of ``revisions`` in plain SQL, written independently with joins and windows."""

from __future__ import annotations

from changelens.plans.registry import cte

STRIP = r"regexp_replace({0}, '[ \t\n\r\x0b\x0c]', '', 'g')"


def strip(expr: str) -> str:
    return STRIP.format(expr)


cte(
    "d_docs",
    """
select doc_id, text, lang,
  concat('src/', doc_id, '.', (['rs','py','js','zig','md'])[doc_id % 5 + 1]) path,
  case doc_id % 5 when 0 then 'rust' when 1 then 'python' when 2 then 'javascript' when 3 then 'zig' end language,
  case doc_id % 12 when 3 then 'added' when 7 then 'removed' when 9 then 'unchanged' else 'changed' end status
from documents
""",
)
cte(
    "d_lines",
    """
select path, status, doc_id, cast(generate_subscripts(s, 1) as bigint) n, unnest(s) c
from (select *, string_split(text, chr(10)) s from d_docs)
""",
)
cte(
    "d_tagged",
    """
select path, n, c, case when (n // 20) % 2 = 1 then 19 else (doc_id * 31 + n * 17) % 20 end h
from d_lines where status = 'changed'
""",
)
cte(
    "d_old",
    """
select path, n, h, row_number() over (partition by path order by n) line,
  case when h = 3 then concat('# ', c) else c end c
from d_tagged where h <> 4
""",
)
cte(
    "d_new",
    """
select path, n, h, row_number() over (partition by path order by n) line,
  case h when 1 then concat('  ', c) when 2 then concat(c, ' x1') when 3 then concat('// ', c)
         when 5 then replace(c, 'the', 'these') else c end c
from d_tagged where h <> 0
""",
)
cte(
    "d_files",
    """
select path, language, status,
  case status when 'added' then '' when 'changed'
    then coalesce((select string_agg(c, chr(10) order by line) from d_old o where o.path = d.path), '') else text end old_content,
  case status when 'removed' then '' when 'changed'
    then coalesce((select string_agg(c, chr(10) order by line) from d_new o where o.path = d.path), '') else text end new_content
from d_docs d
""",
)
cte(
    "d_entries0",
    """
select coalesce(o.path, w.path) path, coalesce(o.n, w.n) n, coalesce(o.h, w.h) h,
  o.line old_line, w.line new_line, o.c old_text, w.c new_text
from d_old o full outer join d_new w on o.path = w.path and o.n = w.n
where coalesce(o.h, w.h) between 0 and 5
""",
)
cte(
    "d_entries1",
    """
select *, sum(brk) over (partition by path order by n rows unbounded preceding) - 1 chunk_idx
from (select *, case when n - lag(n) over (partition by path order by n) <= 4 then 0 else 1 end brk from d_entries0)
""",
)
cte(
    "d_entries2",
    f"""
select *, row_number() over (partition by path, chunk_idx order by coalesce(new_line, old_line), entry_idx) entry_rank,
  coalesce(old_text = new_text, false) same, (h = 2 and n % 2 = 0) bare,
  case when h = 3 then 'comment'
       when h = 2 and n % 2 = 0 then 'semantic'
       when coalesce(old_text, '') = '' and coalesce(new_text, '') = '' then 'semantic'
       when {strip("coalesce(old_text, '')")} = {strip("coalesce(new_text, '')")} then 'whitespace'
       else 'semantic' end category
from (select *, row_number() over (partition by path, chunk_idx order by n) - 1 entry_idx from d_entries1)
""",
)
cte(
    "d_entries",
    """
select *, row_number() over (partition by path order by chunk_idx, entry_rank) - 1 pos from d_entries2
""",
)

# --- unified rows -----------------------------------------------------------------------------------

cte("d_new_count", "select path, max(line) n_new from d_new group by path")
cte(
    "d_bounds",
    """
select *, greatest(first_new - 3, 1) start, greatest(first_old - 3, 1) old_start,
  case when last_new is not null then greatest(least(last_new + 3, n_new), last_new) end reach
from (
  select path, chunk_idx, min(new_line) first_new, max(new_line) last_new, min(old_line) first_old
  from d_entries group by path, chunk_idx
) left join d_new_count using (path)
""",
)
cte(
    "d_shown",
    """
select *, coalesce(max(reach) over (partition by path order by chunk_idx rows between unbounded preceding and 1 preceding), 0) shown
from d_bounds
""",
)
cte(
    "d_context",
    """
select path, chunk_idx, line, start, first_new, last_new
from (select *, unnest(generate_series(start, reach)) line from d_shown where first_new is not null)
where line > shown
""",
)
cte(
    "d_placed",
    """
select c.path, c.chunk_idx, c.line,
  case when c.line < c.first_new then 0 when c.line > c.last_new then 1000000
    else (select min(e.entry_rank) from d_entries e where e.path = c.path and e.chunk_idx = c.chunk_idx and e.new_line > c.line) end rank
from d_context c
where not exists (select 1 from d_entries e where e.path = c.path and e.chunk_idx = c.chunk_idx and e.new_line = c.line)
""",
)
cte(
    "d_stream",
    """
select path, chunk_idx, rank, 0 kind, line, cast(null as bigint) old_line, line new_line, 0 step, cast(null as bigint) jump, false same from d_placed
union all
select path, chunk_idx, entry_rank, 1, 0, old_line, new_line,
  case when old_line is null then 1 when new_line is null then -1 else 0 end,
  case when old_line is not null and new_line is not null and not same then new_line - old_line end, same
from d_entries
""",
)
cte(
    "d_offsets",
    """
select *, coalesce(first_value(jump) over (partition by path, seg order by chunk_idx, rank, kind, line), 0)
   + sum(step) over (partition by path, seg order by chunk_idx, rank, kind, line rows unbounded preceding) shift
from (select *, count(jump) over (partition by path order by chunk_idx, rank, kind, line rows unbounded preceding) seg from d_stream)
""",
)
cte(
    "d_numbered",
    """
select path, chunk_idx, rank, kind, line, same,
  case when kind = 0 then greatest(line - shift, 0) else old_line end old_line, new_line
from d_offsets
""",
)
cte(
    "d_old_marks",
    """
select b.path, b.chunk_idx, (select max(r.old_line) from d_numbered r where r.path = b.path and r.chunk_idx < b.chunk_idx) mark
from d_bounds b where b.first_new is null
""",
)
cte(
    "d_rows",
    """
select r.path, r.chunk_idx, r.rank, r.kind, r.line, 'context' line_type, r.old_line, r.new_line, w.c content,
  cast(null as varchar) old_content, 'semantic' category, false bare, true selectable
from d_numbered r join d_new w on r.path = w.path and r.new_line = w.line where r.kind = 0
union all
select path, chunk_idx, entry_rank, 1, 0,
  case when new_line is null then 'deletion' when old_line is null then 'addition' else 'modification' end,
  old_line, new_line, coalesce(new_text, old_text),
  case when old_line is not null and new_line is not null then old_text end, category, bare, true
from d_entries where not same
union all
select path, chunk_idx, -1, 0, 0, 'context', null, null, '...', null, 'semantic', false, false
from d_shown where first_new is not null and shown > 0 and start > shown + 1
union all
select path, chunk_idx, -1, 0, 0, 'context', null, null, '...', null, 'semantic', false, false
from d_bounds join d_old_marks using (path, chunk_idx) where mark > 0 and old_start > mark + 1
""",
)
cte(
    "d_diff_lines",
    """
select path, row_number() over (partition by path order by chunk_idx, rank, kind, line) - 1 ord,
  line_type, cast(old_line as bigint) old_line, cast(new_line as bigint) new_line, content, old_content, category, bare, selectable
from d_rows
union all
select path, n - 1, case status when 'removed' then 'deletion' when 'added' then 'addition' else 'context' end,
  case when status <> 'added' then n end, case when status <> 'removed' then n end, c, null, 'semantic', false, true
from d_lines where status <> 'changed'
""",
)

# --- regions and constructs ----------------------------------------------------------------------------

cte(
    "d_regions",
    """
select path, side, ix * 5 + 1 start_line, least(ix * 5 + 5, n) end_line, ix * 5 + 1 header_end_line,
  (['function','struct_','enum_','union_','test_decl','class'])[ix % 6 + 1] node_type,
  concat('r', case when length(path) % 2 = 1 then ix % 3 else ix end) name,
  (length(path) + ix) % 2 = 0 collapsed, 1 + ix % 3 level
from (
  select path, side, n, unnest(generate_series(0, (n - 1) // 5)) ix
  from (
    select path, side, count(*) n from (
      select path, 'old' side, c from d_old
      union all select path, 'new', c from d_new
      union all select path, 'old', c from d_lines where status in ('removed', 'unchanged')
      union all select path, 'new', c from d_lines where status in ('added', 'unchanged')
    ) group by path, side having count(*) > 1 or max(length(c)) > 0
  )
)
""",
)
cte("d_new_top", "select * from d_regions where side = 'new' and level = 1 and name <> ''")
cte("d_old_top", "select * from d_regions where side = 'old' and level = 1 and name <> ''")
cte(
    "d_matched",
    """
select n.path, n.name, n.node_type, case when o.path is null then 'added' else 'modified' end change_type,
  n.start_line line_start, n.end_line line_end, o.old_size
from d_new_top n left join (
  select path, name, arg_max(end_line - start_line, start_line) old_size from d_old_top group by path, name
) o on o.path = n.path and o.name = n.name
union all
select path, name, node_type, 'deleted', start_line, end_line, null from d_old_top o
where not exists (select 1 from d_new_top n where n.path = o.path and n.name = o.name)
""",
)
cte("d_changed_lines", "select path, new_line line, category from d_entries where new_line is not null")
cte(
    "d_construct_lines",
    """
select m.path, m.name, m.node_type, m.change_type, m.line_start, m.line_end, m.old_size,
  count(l.line) changes, coalesce(bool_and(l.category <> 'semantic'), true) all_cosmetic,
  arg_min(l.category, l.line) filter (l.category <> 'semantic') first_cosmetic
from d_matched m left join d_changed_lines l on l.path = m.path and l.line between m.line_start and m.line_end
group by all
""",
)
cte(
    "d_constructs",
    """
select path, name, node_type, change_type, cast(line_start as bigint) line_start, cast(line_end as bigint) line_end,
  cast(case when change_type = 'modified' then changes else line_end - line_start + 1 end as bigint) lines_changed,
  case when change_type <> 'modified' or not all_cosmetic then 'semantic'
       when line_end - line_start <> old_size then 'whitespace'
       else coalesce(first_cosmetic, 'semantic') end category
from d_construct_lines
where change_type <> 'modified' or changes > 0 or line_end - line_start <> old_size
""",
)
_COUNTED = ",\n  ".join(
    f"count(*) filter (node_type in ({kinds}) and change_type = '{t}') {bucket}_{t}"
    for bucket, kinds in {
        "functions": "'function'",
        "structs": "'struct_'",
        "enums": "'enum_'",
        "unions": "'union_'",
        "tests": "'test_decl'",
        "other": "'class', 'impl', 'trait', 'interface', 'module', 'other'",
    }.items()
    for t in ("added", "modified", "deleted")
)
COUNTERS = [f"{b}_{t}" for b in ("functions", "structs", "enums", "unions", "tests", "other") for t in ("added", "modified", "deleted")]
cte(
    "d_construct_counts",
    f"""
select path, {_COUNTED},
  count(*) filter (category <> 'semantic') cosmetic_changes, count(*) filter (category = 'semantic') semantic_changes
from d_constructs where path not like '%.md' group by path
""",
)
ALL_COUNTERS = [*COUNTERS, "lines_added", "lines_deleted", "lines_modified", "cosmetic_changes", "semantic_changes"]
cte(
    "d_stats",
    "select path, " + ", ".join(f"cast(coalesce({c}, 0) as bigint) {c}" for c in ALL_COUNTERS) + """
from d_docs left join (
  select path, count(*) filter (old_line is null) lines_added, count(*) filter (new_line is null) lines_deleted,
    count(*) filter (old_line is not null and new_line is not null) lines_modified
  from d_entries group by path
) using (path) left join d_construct_counts using (path)
""",
)
