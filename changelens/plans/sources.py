"""Queries over readers: listings, records, event logs, patches, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.operators import entries as E
from changelens.operators.barrier import bind
from changelens.operators.scan import whole
from changelens.plans.registry import cte, query
from changelens.plans.revisions import diff_records, path_of, spread_table, table
from changelens.sources import diff_json, event_log, listing, patch

# --- listings -----------------------------------------------------------------------------------------

_LETTERS = ("M", "A", "D", "R100", "C075", "?", "X", "")


def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per page: two lines about its address, one of them blank or unknown at times."""
    pages = table(spark, sf_dir, "pages")
    letter = F.get(F.array(*[F.lit(x) for x in _LETTERS]), F.pmod("page_id", F.lit(len(_LETTERS))).cast("int"))
    entry = F.when(
        letter.rlike("^[RC]"), F.concat(letter, F.lit("\told/"), F.col("url"), F.lit("\t"), F.col("url"))
    ).when(letter == "", "").otherwise(F.concat(letter, F.lit("\t"), F.col("url")))
    mode = F.when(F.pmod("page_id", F.lit(3)) == 0, "commit").when(F.pmod("page_id", F.lit(3)) == 1, "staged").otherwise("unstaged")
    second = F.concat(F.lit("M\tdoc/"), F.col("page_id").cast("string"), F.lit(".py"))
    return pages.select(mode.alias("mode"), F.concat(entry, F.lit("\n"), second, F.lit("\n")).alias("text"))


cte(
    "l_lines",
    r"""
select page_id, url, case page_id % 3 when 0 then 'commit' when 1 then 'staged' else 'unstaged' end mode,
  (['M','A','D','R','C','?','X',''])[page_id % 8 + 1] letter from pages
""",
)
cte(
    "l_changed",
    """
select mode, url path,
  case letter when 'M' then 'modified' when 'A' then 'added' when 'D' then 'deleted' when 'R' then 'renamed'
    when 'C' then 'copied' when '?' then 'untracked' end status,
  case when letter in ('R', 'C') then concat('old/', url) end old_path
from l_lines where letter not in ('X', '')
union all
select mode, concat('doc/', page_id, '.py'), 'modified', null from l_lines
""",
)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.parse_listing(listing_texts(spark, sf_dir))


@query("src_name_status", "select mode, path, status, old_path from l_changed")
def src_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_files(spark, sf_dir)


@query("filter_paths", "select path from l_changed where contains(path, '/fr/') or contains(path, '.org') or contains(path, '7.py')")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filter_paths(changed_files(spark, sf_dir), ["/fr/", ".org", "7.py"]).select("path")


@query(
    "diff_sources",
    """
select path, status, case when status in ('added', 'untracked') then '/dev/null' else coalesce(old_path, path) end old_source,
  case when status = 'deleted' then '/dev/null' else path end new_source from l_changed
""",
)
def diff_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.diff_sources(changed_files(spark, sf_dir))
    return rows.select("path", "status", "old_source", "new_source")


@query(
    "language_of",
    """
select url, nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1), '') extension,
  case concat('x.', (['rs','py','MJS','hpp','yml','txt'])[page_id % 6 + 1])
    when 'x.rs' then 'rust' when 'x.py' then 'python' when 'x.hpp' then 'cpp' when 'x.yml' then 'yaml' end language
from pages
""",
)
def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(f"x.{s}") for s in ("rs", "py", "MJS", "hpp", "yml", "txt")])
    name = F.get(kinds, F.pmod("page_id", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "url",
        X.extension("url").alias("extension"),
        X.language_of(F.concat_ws("/", F.col("url"), name)).alias("language"),
    )


# --- contents ------------------------------------------------------------------------------------------


@query(
    "is_binary",
    """
select doc_id, doc_id % 17 = 0 and strlen(text) < 8192 is_binary from documents
""",
)
def is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.when(F.pmod("doc_id", F.lit(17)) == 0, F.concat(F.col("text"), F.chr(F.lit(0)))).otherwise(F.col("text"))
    return docs.select("doc_id", X.is_binary(raw).alias("is_binary"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by (rev, path): every document at HEAD, and edited ones in the index, the worktree and a commit."""
    docs = table(spark, sf_dir, "documents")
    revs = F.array(*[F.struct(F.lit(r).alias("rev"), F.lit(t).alias("tail")) for r, t in _REVISIONS.items()])
    return docs.select(path_of(F.col("doc_id")).alias("path"), "text", F.explode(revs).alias("r")).select(
        "r.rev", "path", F.concat("text", "r.tail").alias("content")
    )


_REVISIONS = {"HEAD": "", "index": " i", "worktree": " w", "c1^": " p", "c1": " c"}
_MODES = ("unstaged", "staged", "commit")


def mode_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(4))
    return docs.select(
        path_of(F.col("doc_id")).alias("path"),
        F.when(kind == 0, "added").when(kind == 1, "removed").otherwise("changed").alias("status"),
        F.get(F.array(*[F.lit(m) for m in _MODES]), F.pmod("doc_id", F.lit(3)).cast("int")).alias("mode"),
        F.lit("c1").alias("commit"),
    )


cte(
    "s_snapshots",
    """
select r.rev, path, concat(text, r.tail) content
from d_docs, (values ('HEAD', ''), ('index', ' i'), ('worktree', ' w'), ('c1^', ' p'), ('c1', ' c')) r(rev, tail)
""",
)


@query(
    "mode_contents",
    """
select path, mode, status,
  case when doc_id % 4 = 0 then '' when doc_id % 3 = 2 then concat(text, ' p') else text end old_content,
  case when doc_id % 4 = 1 then '' else concat(text, (array[' w', ' i', ' c'])[doc_id % 3 + 1]) end new_content,
  false is_binary
from (select doc_id, text, path, (['unstaged','staged','commit'])[doc_id % 3 + 1] mode,
  case doc_id % 4 when 0 then 'added' when 1 then 'removed' else 'changed' end status from d_docs)
""",
)
def mode_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.mode_contents(mode_requests(spark, sf_dir), snapshots(spark, sf_dir))
    return rows.select("path", "mode", "status", "old_content", "new_content", "is_binary")


@query(
    "content_at",
    """
select r.rev, d.path, s.content from d_docs d
join (values ('HEAD'), ('c1'), ('gone')) r(rev) on true
left join s_snapshots s on s.rev = r.rev and s.path = d.path
""",
)
def content_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(
        F.explode(F.array(F.lit("HEAD"), F.lit("c1"), F.lit("gone"))).alias("rev"), path_of(F.col("doc_id")).alias("path")
    )
    return listing.content_at(asked, snapshots(spark, sf_dir))


# --- records --------------------------------------------------------------------------------------------


@query(
    "src_diff_json",
    """
select path, coalesce(language, 'Text') language, 'changed' status, cast(pos as bigint) pos,
  cast(old_line as bigint) old_line, cast(new_line as bigint) new_line,
  case when not bare then case when h = 3 then 'comment' else 'novel' end end highlight
from d_entries join d_docs using (path)
""",
)
def src_diff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of records read back from their JSON text."""
    records = diff_json.parse_records(diff_records(spark, sf_dir))
    contents = records.withColumn("old_content", F.lit("")).withColumn("new_content", F.lit(""))
    rows = E.diff_entries(contents, keep=["language", "status"])
    spans = F.concat("old_changes", "new_changes")
    return rows.select(
        "path", "language", "status", "pos", "old_line", "new_line",
        F.get(spans, F.lit(0))["highlight"].alias("highlight"),
    )


@query("src_diff_json_real_path", "select concat('checkout/', path) path, coalesce(language, 'Text') language from d_docs")
def src_diff_json_real_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under the path of the checkout instead of the one that the diff tool was given."""
    records = diff_json.parse_records(diff_records(spark, sf_dir))
    return diff_json.with_real_path(records, F.concat(F.lit("checkout/"), "path")).select("path", "language")


@query(
    "src_diff_json_defaults",
    "select event_id, 'unknown' path, 'Text' \"language\", 'changed' status, cast(0 as bigint) chunks from events",
)
def src_diff_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without any of the record's fields take every default."""
    props = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("record"))
    parsed = diff_json.parse_records(props)
    return parsed.select("event_id", "path", "language", "status", F.size("chunks").cast("bigint").alias("chunks"))


@query(
    "src_diff_json_concatenated",
    """
select path, coalesce(language, 'Text') language, status from (
  select path, language, case status when 'unchanged' then 'unchanged' else status end status from d_docs
  union all select concat(path, ' {"}'), 'Text', 'added' from d_docs
)
""",
)
def src_diff_json_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that follow each other in one text, some of them no JSON."""
    records = diff_records(spark, sf_dir)
    path = F.get_json_object("record", "$.path")
    other = F.to_json(F.struct(F.concat(path, F.lit(' {"}')).alias("path"), F.lit("created").alias("status")))
    text = F.concat(F.lit("\n "), F.col("record"), other, F.lit("\n{ broken }\n{"))
    split = diff_json.split_objects(records.select(text.alias("text")), "text")
    return diff_json.parse_records(split).select("path", "language", "status")


@query(
    "status_map",
    """
select event_id, case event_type when 'view' then 'added' when 'click' then 'removed' when 'purchase' then 'unchanged'
  when 'signup' then 'added' else 'changed' end status from events
""",
)
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"view": "created", "click": "deleted", "purchase": "unchanged", "signup": "added", "error": "moved"}
    events = table(spark, sf_dir, "events")
    return events.select("event_id", diff_json.status_of(X.mapped("event_type", words)).alias("status"))


# --- event logs -------------------------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the log of one answer: text deltas, for some an error or no text at all."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.pmod("conv_id", F.lit(13))
    delta = F.to_json(
        F.struct(
            F.lit("message_update").alias("type"),
            F.struct(F.lit("text_delta").alias("type"), F.col("text").alias("delta")).alias("delta"),
        )
    )
    failed = F.format_string('{"success":false,"error":"failed at turn %d"}', "turn")
    idle = F.format_string('{"type":"status","turn":%d,"role":"%s"}', "turn", "role")
    line = F.when((kind == 5) & (F.col("turn") > 0), failed).when(kind == 7, idle).otherwise(delta)
    return turns.select(F.col("conv_id").alias("log"), F.col("turn").alias("pos"), line.alias("line"))


@query(
    "src_event_log",
    """
select conv_id log, cast(0 as bigint) part,
  case when conv_id % 13 = 5 and max(turn) > 0 then 'error' when conv_id % 13 = 7 then 'empty' else 'text' end outcome,
  case when conv_id % 13 = 5 and max(turn) > 0 then concat('The helper returned an error:', chr(10), 'failed at turn ', max(turn))
       when conv_id % 13 = 7 then concat('No text response found.', chr(10), chr(10), 'Raw output preview (',
         sum(strlen(concat('{"type":"status","turn":', turn, ',"role":"', role, '"}')) + 1) - 1, ' bytes total):', chr(10),
         string_agg(concat('{"type":"status","turn":', turn, ',"role":"', role, '"}'), chr(10) order by turn)[:500],
         case when sum(strlen(concat('{"type":"status","turn":', turn, ',"role":"', role, '"}')) + 1) - 1 > 500 then concat(chr(10), '...') else '' end)
       else string_agg(text, '' order by turn) end text
from conversations group by conv_id
""",
)
def src_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.responses(event_lines(spark, sf_dir))


# --- unified diffs ------------------------------------------------------------------------------------------


def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, diff): every document as a patch with one hunk per 20 lines."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    docs = bind(docs, lines=X.text_lines("text"))

    def hunk_line(c: Column, i: Column) -> Column:
        n = i.cast("bigint") + 1
        h = F.pmod(F.col("doc_id") * 31 + n * 17, F.lit(20))
        shown = (
            F.when(h == 0, F.concat(F.lit("-"), c))
            .when(h == 4, F.concat(F.lit("+"), c))
            .when(h < 6, F.concat(F.lit("-"), c, F.lit("\n+"), c, F.lit("!")))
            .when(h == 19, F.concat(F.lit(" "), c, F.lit("\n\\ No newline at end of file")))
            .otherwise(F.concat(F.lit(" "), c))
        )
        block = whole(i, 20)
        header = F.when(
            F.pmod(block, F.lit(2)) == 0, F.format_string("@@ -%d,20 +%d,21 @@ x\n", block * 20 + 1, block * 21 + 1)
        ).otherwise(F.format_string("@@ -%d +%d @@\n", block * 20 + 1, block * 21 + 1))
        return F.concat(F.when(F.pmod(i, F.lit(20)) == 0, header).otherwise(""), shown)

    path = path_of(F.col("doc_id"))
    top = F.concat(F.lit("diff a/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    return docs.select(
        "doc_id", path.alias("path"), F.concat(top, F.array_join(F.transform("lines", hunk_line), "\n")).alias("diff")
    )


def _range() -> tuple[Column, Column]:
    """The selected new lines of each file."""
    return F.lit(3), F.pmod("doc_id", F.lit(30)) + 5


cte(
    "u_raw",
    r"""
select doc_id, path, n, c, (n - 1) // 20 block, (doc_id * 31 + n * 17) % 20 h
from (select doc_id, path, cast(generate_subscripts(s, 1) as bigint) n, unnest(s) c
  from (select doc_id, path, string_split(text, chr(10)) s from d_docs))
""",
)
cte(
    "u_lines",
    r"""
select doc_id, path, block, n * 4 k, case h when 0 then '-' when 4 then '+' else case when h < 6 then '-' else ' ' end end kind, c from u_raw
union all select doc_id, path, block, n * 4 + 1, '+', concat(c, '!') from u_raw where h < 6 and h not in (0, 4)
union all select doc_id, path, block, n * 4 + 2, '\', ' No newline at end of file' from u_raw where h = 19
""",
)
cte(
    "u_numbered",
    r"""
select doc_id, path, block + 1 hunk, k, kind, concat(kind, c) text,
  block * 20 + 1 + sum(case when kind in ('-', ' ') then 1 else 0 end) over w - case when kind in ('-', ' ') then 1 else 0 end old_no,
  block * 21 + 1 + sum(case when kind in ('+', ' ') then 1 else 0 end) over w - case when kind in ('+', ' ') then 1 else 0 end new_no,
  3 first, doc_id % 30 + 5 last, block * 20 + 1 old_start, block * 21 + 1 new_start
from u_lines window w as (partition by path, block order by k rows unbounded preceding)
""",
)
cte(
    "u_kept0",
    r"""
select *, (kind in ('+', ' ') and new_no between first and last) or (kind = '-' and new_no between first and last + 1) ok from u_numbered
""",
)
cte(
    "u_kept",
    r"""
select *, ok or (kind = '\' and coalesce(bool_or(ok) over (partition by path, hunk order by k rows between unbounded preceding and 1 preceding), false)) keep
from u_kept0
""",
)


@query(
    "src_unified_diff",
    """
select path, cast(hunk as bigint) hunk, kind, text, cast(old_no as bigint) old_no, cast(new_no as bigint) new_no, keep from u_kept
""",
)
def src_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patch.hunk_lines(unified_diffs(spark, sf_dir), *_range())
    return rows.select("path", "hunk", "kind", "text", "old_no", "new_no", "keep")


cte(
    "u_hunks",
    """
select path, hunk,
  coalesce(min(old_no) filter (keep and kind in ('-', ' ')), any_value(old_start)) old_start,
  count(*) filter (keep and kind in ('-', ' ')) old_count,
  coalesce(min(new_no) filter (keep and kind in ('+', ' ')), any_value(new_start)) new_start,
  count(*) filter (keep and kind in ('+', ' ')) new_count,
  string_agg(concat(text, chr(10)), '' order by k) filter (keep) body
from u_kept group by path, hunk having bool_or(keep)
""",
)


@query(
    "filter_hunk_lines",
    """
select path, cast(hunk as bigint) hunk, cast(old_start as bigint) old_start, cast(old_count as bigint) old_count,
  cast(new_start as bigint) new_start, cast(new_count as bigint) new_count, body from u_hunks
""",
)
def filter_hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = patch.partial_hunks(unified_diffs(spark, sf_dir), *_range())
    return hunks.select("path", F.inline("hunks"))


@query(
    "partial_patch",
    """
select d.path, case when h.text is null then '' else concat('diff a/', d.path, chr(10), '--- a/', d.path, chr(10), '+++ b/', d.path, chr(10), h.text) end patch
from d_docs d left join (
  select path, string_agg(concat('@@ -', old_start, ',', old_count, ' +', new_start, ',', new_count, ' @@', chr(10), body), '' order by hunk) text
  from u_hunks group by path) h on h.path = d.path
""",
)
def partial_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch.partial_patch(unified_diffs(spark, sf_dir), *_range())


@query(
    "hunk_headers",
    """
select path, cast(block + 1 as bigint) hunk, cast(block * 20 + 1 as bigint) old_start,
  cast(case when block % 2 = 0 then 20 else 1 end as bigint) old_count, cast(block * 21 + 1 as bigint) new_start,
  cast(case when block % 2 = 0 then 21 else 1 end as bigint) new_count,
  block * 21 + 1 <= 30 and block * 21 + case when block % 2 = 0 then 21 else 1 end >= 10 hits_range
from (select distinct path, block from u_raw)
""",
)
def hunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(X.text_lines("diff"), lambda c: c.startswith("@@"))
    rows = unified_diffs(spark, sf_dir).select("path", F.posexplode(lines).alias("i", "line"))
    rows = rows.select("path", (F.col("i") + 1).cast("bigint").alias("hunk"), X.hunk_header("line").alias("r")).select(
        "path", "hunk", "r.*"
    )
    return rows.withColumn(
        "hits_range", X.hunk_overlaps(F.col("new_start"), F.col("new_count"), F.lit(10), F.lit(30))
    )
