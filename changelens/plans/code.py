"""Queries over source code: outline, tokens, identifiers, renames and moves.

The documents are prose, so they are dressed up as code row by row: every five lines become the
body of a construct in the file's language. The new version renames a variable in some bodies,
edits others, drops some constructs and moves the odd ones to the front.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions import similarity
from changelens.functions.text import text_lines
from changelens.operators import constructs as C
from changelens.operators import entries as E
from changelens.operators import moves as M
from changelens.operators import outline as O
from changelens.operators import source_code as K
from changelens.operators import summary as S
from changelens.operators.barrier import bind, prefix_sum
from changelens.operators.scan import whole
from changelens.plans.registry import CTES, cte, query
from changelens.plans.relations_sql import ALL_COUNTERS
from changelens.plans.revisions import files, spread_table

LANGUAGES = ("rust", "python", "javascript", "zig")
SUFFIXES = ("rs", "py", "js", "zig")
BODY = 5

# Opening lines of the three shapes of a construct, per language: plain, nested in a container, other.
_OPEN = {
    "rust": (["fn f@() {"], ["mod m@ {", "    fn g@() {"], ["pub fn h@()", "{"]),
    "python": (["def f@():"], ["class C@:", "    def g@(self):"], ["async def h@():"]),
    "javascript": (["function f@() {"], ["class C@ {", "    g@(a) {"], ["async function h@() {"]),
    "zig": (["fn f@() void {"], ["const M@ = struct {", "    fn g@() void {"], ['test "t {" {']),
}
_CLOSE = {
    "rust": (["}"], ["    }", "}"], ["}"]),
    "python": ([], [], []),
    "javascript": (["}"], ["    }", "}"], ["}"]),
    "zig": (["}"], ["    }", "};"], ["}"]),
}


def _by_shape(table: dict, language: Column, shape: Column, number: Column) -> Column:
    """The fixed lines of a construct with its number filled in."""
    value = None
    for lang, shapes in table.items():
        for i, lines in enumerate(shapes):
            made = F.array(*[F.lit(x) for x in lines]) if lines else F.array().cast("array<string>")
            hit = (language == lang) & (shape == i)
            value = F.when(hit, made) if value is None else value.when(hit, made)
    return F.transform(value, lambda x: F.replace(x, F.lit("@"), number.cast("string")))


def code_files(spark: SparkSession, sf_dir: str, chunks: bool = False) -> DataFrame:
    """(path, language, status, is_binary, old_content, new_content[, chunks]) of the dressed-up documents.

    The chunks record each line that differs from its counterpart in the moved construct, and each
    line of a dropped construct; where only a mark was added they call it a comment.
    """
    docs = spread_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    k = F.pmod("doc_id", F.lit(len(LANGUAGES))).cast("int")
    docs = docs.withColumn("language", F.get(F.array(*[F.lit(x) for x in LANGUAGES]), k)).withColumn(
        "path",
        F.concat(F.lit("code/"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*[F.lit(x) for x in SUFFIXES]), k)),
    )
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    docs = bind(docs, lines=text_lines(escaped))
    count = whole(F.size("lines") - 1, BODY) + 1
    docs = bind(docs, groups=F.sequence(F.lit(0).cast("bigint"), count - 1))
    mark = F.when(F.col("language") == "python", "#").otherwise("//")

    def construct(g: Column, new: bool) -> Column:
        shape = F.pmod(g, F.lit(3))
        pad = F.when(shape == 1, " " * 8).otherwise(" " * 4)

        name = F.when(F.pmod(g, F.lit(4)) == 1, "node").otherwise("item") if new else F.lit("item")
        ends = F.struct(
            F.concat(pad, name, F.lit(' = "')).alias("first"), F.concat(F.lit('" '), mark, F.lit(" "), g.cast("string")).alias("last")
        )

        def with_ends(e: Column) -> Column:
            def body_line(c: Column, i: Column) -> Column:
                if new:
                    return F.concat(e["first"], c, F.when((F.pmod(g, F.lit(4)) == 3) & (i == 0), "?").otherwise(""), e["last"])
                return F.concat(e["first"], c, e["last"])

            return F.transform(F.slice("lines", (g * BODY + 1).cast("int"), F.lit(BODY)), body_line)

        body = F.get(F.transform(F.array(ends), with_ends), F.lit(0))
        return F.concat(
            _by_shape(_OPEN, F.col("language"), shape, g), body, _by_shape(_CLOSE, F.col("language"), shape, g)
        )

    odd = F.filter("groups", lambda g: g % 2 == 1)
    even = F.filter("groups", lambda g: (g % 2 == 0) & (g % 5 != 4))
    docs = bind(
        docs,
        old_parts=F.transform("groups", lambda g: construct(g, False)),
        new_parts=F.transform("groups", lambda g: construct(g, True)),
        order=F.concat(odd, even),
    )
    recorded = []
    if chunks:
        docs = bind(
            docs,
            old_end=F.transform("old_parts", lambda x: F.size(x).cast("bigint")),
            new_end=F.transform("order", lambda g: F.size(F.get("new_parts", g.cast("int"))).cast("bigint")),
        )
        docs = bind(docs, old_end=prefix_sum("old_end"), new_end=prefix_sum("new_end"))
        recorded = [F.filter(F.transform("groups", _entries), lambda c: F.size(c) > 0).cast(schemas.CHUNKS).alias("chunks")]
    return docs.select(
        "path",
        "language",
        F.lit("changed").alias("status"),
        F.lit(False).alias("is_binary"),
        F.array_join(F.flatten("old_parts"), "\n").alias("old_content"),
        F.array_join(F.flatten(F.transform("order", lambda g: F.get("new_parts", g.cast("int")))), "\n").alias("new_content"),
        *recorded,
    )


def _entries(g: Column) -> Column:
    """The entries of construct ``g``: its lines that are gone, or that differ."""
    old, new = F.get("old_parts", g.cast("int")), F.get("new_parts", g.cast("int"))
    dropped = (g % 2 == 0) & (g % 5 == 4)
    # The odd constructs come first; of the even ones before this, each tenth from the fourth on is dropped.
    place = F.when(g % 2 == 1, whole(g - 1, 2)).otherwise(whole(F.size("groups").cast("bigint"), 2) + whole(g, 2) - whole(g + 5, 10))
    old_first = F.get("old_end", g.cast("int")) - F.size(old)
    new_first = F.get("new_end", place.cast("int")) - F.size(new)

    def side(number: Column, text: Column) -> Column:
        token = F.struct(
            F.lit(0).alias("start"), F.octet_length(text).cast("int").alias("end"), text.alias("content"),
            F.when(g % 4 == 3, "comment").otherwise("novel").alias("highlight"),
        )
        return F.struct(number.cast("int").alias("line_number"), F.array(token).alias("changes"))

    def entry(c: Column, j: Column) -> Column:
        other = F.get(new, j)
        return F.when(
            dropped | (c != other),
            F.struct(side(old_first + j, c).alias("lhs"), F.when(~dropped, side(new_first + j, other)).alias("rhs")),
        )

    return F.array_compact(F.transform(old, entry))


def _case(table: dict, part: int) -> str:
    """The n-th fixed line of each shape as a SQL CASE over (language, shape)."""
    rows = []
    for lang, shapes in table.items():
        for i, lines in enumerate(shapes):
            if part < len(lines):
                text = lines[part].replace("'", "''")
                rows.append(f"when language = '{lang}' and g % 3 = {i} then replace('{text}', '@', cast(g as varchar))")
    return "case " + " ".join(rows) + " end"


cte(
    "k_docs",
    """
select doc_id, string_split(text, chr(10)) l, (['rust','python','javascript','zig'])[doc_id % 4 + 1] language,
  concat('code/', doc_id, '.', (['rs','py','js','zig'])[doc_id % 4 + 1]) path
from documents
""",
)
cte(
    "k_groups",
    """
select side, path, language, l, g, case when side = 'old' then g when g % 2 = 1 then g - 1000000 else g end place
from (select *, unnest(generate_series(0, (len(l) - 1) // 5)) g from k_docs), (values ('old'), ('new')) s(side)
where side = 'old' or g % 2 = 1 or g % 5 <> 4
""",
)
cte(
    "k_parts",
    f"""
select side, path, language, g, place, 0 seq, {_case(_OPEN, 0)} text, 'open' part, cast(null as varchar) quoted from k_groups
union all select side, path, language, g, place, 1, {_case(_OPEN, 1)}, 'open2', null from k_groups
union all
select side, path, language, g, place, 10 + i,
  concat(case when g % 3 = 1 then '        ' else '    ' end, case when side = 'new' and g % 4 = 1 then 'node' else 'item' end, ' = "',
    replace(replace(l[g * 5 + i], '\\', '\\\\'), '"', '\\"'), case when side = 'new' and g % 4 = 3 and i = 1 then '?' else '' end, '" ',
    case language when 'python' then '#' else '//' end, ' ', g), 'body',
  concat('"', replace(replace(l[g * 5 + i], '\\', '\\\\'), '"', '\\"'), case when side = 'new' and g % 4 = 3 and i = 1 then '?' else '' end, '"')
from (select *, unnest(generate_series(1, least(5, len(l) - g * 5))) i from k_groups)
union all select side, path, language, g, place, 20, {_case(_CLOSE, 0)}, 'close', null from k_groups
union all select side, path, language, g, place, 21, {_case(_CLOSE, 1)}, 'close2', null from k_groups
""",
)
cte(
    "k_lines",
    """
select *, row_number() over (partition by side, path order by place, seq) line from k_parts where text is not null
""",
)
cte(
    "k_contents",
    "select side, path, language, string_agg(text, chr(10) order by line) content from k_lines group by side, path, language",
)


@query("code_files", "select side, path, language, content from k_contents")
def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.by_side(code_files(spark, sf_dir))


def code_regions(pairs: DataFrame) -> DataFrame:
    return O.find_regions(pairs)


def code_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.find_regions(code_files(spark, sf_dir), bodies=True)


# What the generator put there: regions follow from its parts, not from reading the text.
cte(
    "k_regions",
    """
select side, path, start_line, end_line, header_end_line, node_type, name, level from (
  select side, path,
    min(line) start_line, max(line) end_line,
    case when g % 3 = 2 and language = 'rust' then min(line) else min(line) end header_end_line,
    case language || (g % 3) when 'rust1' then 'module' when 'python1' then 'class' when 'javascript1' then 'class' when 'zig1' then 'struct_'
      when 'zig2' then 'test_decl' else 'function' end node_type,
    case language || (g % 3) when 'rust1' then concat('m', g) when 'zig1' then concat('M', g) when 'python1' then concat('C', g)
      when 'javascript1' then concat('C', g) when 'zig2' then '' else concat((['f', '', 'h'])[g % 3 + 1], g) end name,
    1 level
  from k_lines group by side, path, language, g
  union all
  select side, path, min(line) filter (part = 'open2'),
    case when language = 'python' then max(line) else max(line) filter (part = 'close') end, min(line) filter (part = 'open2'),
    'function', concat('g', g), 2
  from k_lines where g % 3 = 1 group by side, path, language, g
)
""",
)
_K_REGION = (
    "side, path, cast(start_line as bigint) start_line, cast(end_line as bigint) end_line, "
    "cast(header_end_line as bigint) header_end_line, node_type, name, cast(level as bigint) level"
)


@query("find_regions", f"select {_K_REGION} from k_regions")
def find_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_regions(code_files(spark, sf_dir)).drop("collapsed")


# A header with parameters over two lines: the part takes two lines, and the region's header ends with the second.
_WIDE = r"(?m)^((?:async def|async function|pub fn) h[0-9]+\(|    g[0-9]+\(a)\)"
cte(
    "k_wide",
    """
select *, sum(height) over (partition by side, path order by line) last_line from (
  select *, case when (part = 'open' and g % 3 = 2 and language <> 'zig') or (part = 'open2' and g % 3 = 1 and language = 'javascript')
    then 2 else 1 end height
  from k_lines)
""",
)


@query(
    "find_regions_wide",
    f"""
select {_K_REGION} from (
  select side, path, min(last_line - height + 1) start_line, max(last_line) end_line, min(last_line) filter (part = 'open') header_end_line,
    case language || (g % 3) when 'rust1' then 'module' when 'python1' then 'class' when 'javascript1' then 'class' when 'zig1' then 'struct_'
      when 'zig2' then 'test_decl' else 'function' end node_type,
    case language || (g % 3) when 'rust1' then concat('m', g) when 'zig1' then concat('M', g) when 'python1' then concat('C', g)
      when 'javascript1' then concat('C', g) when 'zig2' then '' else concat((['f', '', 'h'])[g % 3 + 1], g) end name,
    1 level
  from k_wide group by side, path, language, g
  union all
  select side, path, min(last_line - height + 1) filter (part = 'open2'),
    case when language = 'python' then max(last_line) else max(last_line) filter (part = 'close') end, min(last_line) filter (part = 'open2'),
    'function', concat('g', g), 2
  from k_wide where g % 3 = 1 group by side, path, language, g
)
""",
)
def find_regions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline where parameters of some headers stand on a line of their own."""
    wide = {
        c: F.regexp_replace(c, _WIDE, "$1\n        a=[1], b=(1, 2))") for c in ("old_content", "new_content")
    }
    return code_regions(code_files(spark, sf_dir).withColumns(wide)).drop("collapsed")


# --- tokens -----------------------------------------------------------------------------------------------

# Tokens of the parts that the generator put together: its fixed lines are words, blanks, quoted words and single marks, and a
# body line is indent, name, ` = `, the quoted text and the comment.
cte(
    "k_line_tokens",
    r"""
select side, path, language, line, list_concat(
  case when part = 'body' then [case when g % 3 = 1 then '        ' else '    ' end, case when side = 'new' and g % 4 = 1 then 'node' else 'item' end,
      ' ', '=', ' ', quoted, ' ', concat(case language when 'python' then '#' else '//' end, ' ', g)]
    else regexp_extract_all(text, '"[^"]*"|[A-Za-z0-9]+|[ ]+|.') end,
  case when line < max(line) over (partition by side, path) then [chr(10)] else [] end) t
from k_lines
""",
)
cte(
    "k_tokens",
    """
select side, path, language, pos, token, sum(strlen(token)) over w end_byte, sum(case when token = chr(10) then 1 else 0 end) over w breaks
from (
  select side, path, language, token, row_number() over (partition by side, path order by line, i) - 1 pos
  from (select side, path, language, line, unnest(t) token, generate_subscripts(t, 1) i from k_line_tokens)
) window w as (partition by side, path order by pos)
""",
)

_TOKENS_SQL = """
select path, cast(pos as bigint) pos, token, cast(end_byte - strlen(token) as bigint) start_byte, cast(end_byte as bigint) end_byte,
  cast(breaks - case when token = chr(10) then 1 else 0 end + 1 as bigint) line
from k_tokens where side = '{}'
"""


def _tokens(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return K.token_rows(code_files(spark, sf_dir), side).select("path", "pos", "token", "start_byte", "end_byte", "line")


@query("tokens", _TOKENS_SQL.format("new"))
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "new")


@query("tokens_old", _TOKENS_SQL.format("old"))
def tokens_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "old")


# The generated code is made of few words, so its classes can be listed.
cte(
    "k_spans",
    """
select side, path, end_byte - strlen(token) start_byte, end_byte, case
  when token[1] = '"' then 'string' when token[1:2] = '//' or token[1] = '#' then 'comment'
  when token in ('fn', 'mod', 'pub', 'def', 'class', 'async', 'self', 'const', 'struct', 'test') then 'keyword'
  when token = 'void' then 'type_' when token in ('=') then 'operator'
  when token in ('(', ')', '{', '}', ':', ';') then 'punctuation' end highlight
from k_tokens
""",
)


@query(
    "highlight_spans",
    """
select path, side, cast(start_byte as bigint) start_byte, cast(end_byte as bigint) end_byte, highlight
from k_spans where highlight is not null and side = 'new'
""",
)
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.highlight_spans(code_files(spark, sf_dir), "new")


@query(
    "highlight_spans_old",
    """
select path, side, cast(start_byte as bigint) start_byte, cast(end_byte as bigint) end_byte, highlight
from k_spans where highlight is not null and side = 'old'
""",
)
def highlight_spans_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.highlight_spans(code_files(spark, sf_dir), "old")


@query(
    "span_order",
    """
select path, cast(row_number() over (partition by path order by start_byte) - 1 as bigint) nth, cast(start_byte as bigint) start_byte, highlight
from k_spans where highlight is not null and side = 'new'
""",
)
def span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each highlighted span in its file."""
    shown = F.filter("spans", lambda x: x["highlight"] != "none")
    rows = K.with_spans(code_files(spark, sf_dir), "new").select("path", F.posexplode(shown).alias("nth", "x"))
    return rows.select("path", F.col("nth").cast("bigint").alias("nth"), "x.start_byte", "x.highlight")


@query(
    "syntax_span_at",
    """
select path, cast(unnest(list_distinct([start_byte, end_byte - 1])) as bigint) byte_at, highlight from k_spans where side = 'new'
""",
)
def syntax_span_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlight class at the first and the last byte of every token of each file."""
    df = K.with_spans(code_files(spark, sf_dir), "new")
    ends = F.flatten(F.transform("spans", lambda x: F.array(x["start_byte"], x["end_byte"] - 1)))
    found = K.highlights_at(bind(df, points=F.array_distinct(ends)))
    return found.select("path", "byte_at", "highlight")


@query(
    "token_change_at",
    """
select path, pos, byte_at, not bare and byte_at < n changed from (
  select path, cast(pos as bigint) pos, cast(unnest(list_distinct(list_filter([0, 4, n // 2, n - 1, n], lambda b: b >= 0))) as bigint) byte_at, bare, n
  from (select path, pos, bare, strlen(new_text) n from d_entries where new_line is not null)
)
""",
)
def token_change_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a recorded change of the new side cover a byte: at, within and beyond the ends of every changed line."""
    rows = E.diff_entries(files(spark, sf_dir)).filter("new_line is not null")
    n = F.octet_length("new_text")
    asked = F.array_distinct(F.filter(F.array(F.lit(0), F.lit(4), F.floor(n / 2).cast("int"), n - 1, n), lambda b: b >= 0))
    rows = rows.select("path", "pos", "new_changes", F.explode(asked).alias("at"))
    covers = F.exists("new_changes", lambda c: (c["start"] <= F.col("at")) & (F.col("at") < c["end"]))
    return rows.select("path", "pos", F.col("at").cast("bigint").alias("byte_at"), covers.alias("changed"))


# --- identifiers --------------------------------------------------------------------------------------------

cte(
    "k_names",
    r"""
select side, path, token name, pos, row_number() over (partition by side, path order by pos) - 1 nth from k_tokens
where regexp_matches(token, '^[\p{L}_]')
  and token not in ('fn', 'mod', 'pub', 'def', 'class', 'async', 'self', 'function', 'const', 'struct', 'test', 'void')
""",
)
cte(
    "k_ids",
    """
select side, path, name, row_number() over (partition by side, path order by first_pos) - 1 id
from (select side, path, name, min(pos) first_pos from k_names group by side, path, name)
""",
)


@query("identifiers", "select path, name, cast(pos as bigint) pos from k_names where side = 'old'")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.identifier_rows(code_files(spark, sf_dir), "old").select("path", "name", "pos")


@query("identifiers_new", "select path, name, cast(pos as bigint) pos from k_names where side = 'new'")
def identifiers_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.identifier_rows(code_files(spark, sf_dir), "new").select("path", "name", "pos")


@query("placeholder_ids_old", "select path, name, cast(id as bigint) id from k_ids where side = 'old'")
def placeholder_ids_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.placeholder_ids(code_files(spark, sf_dir), "old")


@query("placeholder_ids", "select path, name, cast(id as bigint) id from k_ids where side = 'new'")
def placeholder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.placeholder_ids(code_files(spark, sf_dir), "new")


_NORMALIZED_SQL = """
select t.path, string_agg(coalesce('_id' || i.id, t.token), '' order by t.pos) normalized
from k_tokens t left join k_names n using (side, path, pos) left join k_ids i on i.side = n.side and i.path = n.path and i.name = n.name
where t.side = '{}' group by t.path
"""


@query("normalized_files", _NORMALIZED_SQL.format("new"))
def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.normalized_files(code_files(spark, sf_dir), "new")


@query("normalized_files_old", _NORMALIZED_SQL.format("old"))
def normalized_files_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.normalized_files(code_files(spark, sf_dir), "old")


@query(
    "rename_map",
    """
select o.path, o.name old_name, n.name new_name, cast(count(*) as bigint) "count", cast(min(o.nth) as bigint) first_at
from k_names o join k_names n on n.side = 'new' and o.side = 'old' and o.path = n.path and o.nth = n.nth
join (select path from k_names group by path having count(*) filter (side = 'old') = count(*) filter (side = 'new')) e on e.path = o.path
where o.name <> n.name group by o.path, o.name, n.name
""",
)
def rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rename_map(code_files(spark, sf_dir))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, a, b): a call with all words of each line as arguments, and variants that rename, respace or change it."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.posexplode(text_lines("text")).alias("p", "c"))
    n = (F.col("p") + 1).cast("bigint")
    k = F.pmod(F.col("doc_id") + n, F.lit(5))
    found = F.regexp_extract_all(F.lower("c"), F.lit("[a-z]+"), F.lit(0))
    docs = bind(docs, words=found)
    docs = bind(docs, words=F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit("w"))))

    def call(prefix: str, given: Column, gap: str = " = ") -> Column:
        return F.concat(F.lit(f"let r{gap}f("), F.array_join(F.transform(given, lambda w: F.concat(F.lit(prefix), w)), ", "), F.lit(");"))

    words = F.col("words")
    b = (
        F.when(k == 0, call("u_", words))
        .when(k == 1, call("v_", words, "  =  "))
        .when(k == 2, call("v_", F.slice(words, F.lit(1), F.size(words) - 1)))
        .when(k == 3, call("v_", F.concat(words, F.slice(words, F.lit(1), F.lit(1)))))
        .otherwise("")
    )
    return bind(docs.withColumn("n", n), a=call("v_", words), b=b).select("doc_id", "n", "a", "b")


cte(
    "k_pairs",
    """
select doc_id, n, k, case when len(w) = 0 then ['w'] else w end words
from (select doc_id, n, (doc_id + n) % 5 k, regexp_extract_all(lower(c), '[a-z]+') w from d_lines)
""",
)


@query("is_rename", "select doc_id, n, k = 0 renamed from k_pairs")
def is_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_pairs(spark, sf_dir)
    return rows.select("doc_id", "n", K.is_rename("a", "b", F.lit("rust")).alias("renamed"))


@query(
    "rename_analysis",
    """
select doc_id, n, case when k = 0 then 'rename' else 'semantic' end category, cast(1 as double) confidence,
  case when k = 0 then concat('v_', words[1]) end old_name, case when k = 0 then concat('u_', words[1]) end new_name from k_pairs
""",
)
def rename_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_pairs(spark, sf_dir)
    return rows.select("doc_id", "n", K.rename_analysis("a", "b", F.lit("rust")).alias("r")).select("doc_id", "n", "r.*")


@query(
    "normalized_lines",
    """
select doc_id, n, concat('let _id0 = _id1(', array_to_string(list_transform(words, lambda w: '_id' || (list_position(names, w) + 1)), ', '), ');') normalized
from (select *, list_filter(words, lambda w, i: list_position(words, w) = i) names from k_pairs)
""",
)
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pairs(spark, sf_dir).select("doc_id", "n", K.normalized("a", F.lit("rust")).alias("normalized"))


# --- moves ------------------------------------------------------------------------------------------------------

cte(
    "k_moves",
    """
select o.path, o.name, o.node_type, o.start_line old_start_line, o.end_line old_end_line,
  n.start_line new_start_line, n.end_line new_end_line
from k_regions o join k_regions n on o.side = 'old' and n.side = 'new' and o.path = n.path and o.name = n.name and o.node_type = n.node_type
where o.name <> '' and (o.start_line <> n.start_line or o.end_line <> n.end_line)
""",
)


# A construct of g % 4 = 1 has "node" for "item" on each of its lines. The two words share one letter, at
# whatever place, so no alignment keeps more than one of the four, and keeping the rest keeps one. Where
# g % 4 = 3 the new version has one more mark.
cte(
    "k_sizes",
    r"""
select r.path, r.name, r.node_type, r.level, r.start_line, r.end_line,
  (select min(l.g) from k_lines l where l.side = r.side and l.path = r.path and l.line = r.start_line) g,
  (select sum(strlen(regexp_replace(l.text, '[ \t\n\r\x0B\f]', '', 'g'))) from k_lines l
   where l.side = r.side and l.path = r.path and l.line > r.header_end_line and l.line <= r.end_line) size,
  (select count(*) from k_lines l where l.side = r.side and l.path = r.path and l.line > r.header_end_line and l.line <= r.end_line and l.part = 'body') n
from k_regions r where r.side = 'old' and r.name <> ''
""",
)
cte(
    "k_similar",
    """
select *, round(case g % 4 when 1 then cast(size - 3 * n as double) / size when 3 then cast(size as double) / (size + 1) else 1 end, 6) similarity
from k_sizes
""",
)


@query(
    "region_bodies",
    """
select r.side, r.path, r.name, cast(r.start_line as bigint) start_line,
  string_agg(l.text, chr(10) order by l.line) || case when r.end_line < (select max(m.line) from k_lines m where m.side = r.side and m.path = r.path) then chr(10) else '' end body
from k_regions r join k_lines l on l.side = r.side and l.path = r.path and l.line > r.header_end_line and l.line <= r.end_line
group by r.side, r.path, r.name, r.start_line, r.end_line
""",
)
def region_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = code_bodies(spark, sf_dir)
    return bodies.select("side", "path", "name", "start_line", "body").filter("body <> ''")


@query(
    "moved_constructs",
    """
select path, name, node_type, cast(m.old_start_line as bigint) old_start_line, cast(m.old_end_line as bigint) old_end_line,
  cast(m.new_start_line as bigint) new_start_line, cast(m.new_end_line as bigint) new_end_line, s.similarity
from k_moves m join k_similar s using (path, name, node_type) where s.similarity >= 0.9
""",
)
def moved_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = M.moved_constructs(code_bodies(spark, sf_dir).filter("name <> ''"))
    return moved.withColumn("similarity", F.round("similarity", 6))


cte(
    "k_same_moves",
    """
select m.* from k_moves m
where (select string_agg(translate(l.text, ' ', ''), '' order by l.line) from k_lines l where l.side = 'old' and l.path = m.path and l.line > m.old_start_line and l.line <= m.old_end_line)
    = (select string_agg(translate(l.text, ' ', ''), '' order by l.line) from k_lines l where l.side = 'new' and l.path = m.path and l.line > m.new_start_line and l.line <= m.new_end_line)
""",
)
_MOVE = "path, name, node_type, " + ", ".join(
    f"cast({c} as bigint) {c}" for c in ("old_start_line", "old_end_line", "new_start_line", "new_end_line")
)


@query("moved_unchanged", f"select {_MOVE} from k_same_moves")
def moved_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs that moved with the same body up to whitespace."""
    moved = M.moved_constructs(code_bodies(spark, sf_dir).filter("name <> ''"), threshold=0.999999)
    return moved.filter("similarity = 1").drop("similarity")


def _moved_lines_sql(side: str) -> str:
    return f"""
select l.path, cast(l.line as bigint) line, exists (
  select 1 from k_same_moves m where m.path = l.path and l.line between m.{side}_start_line and m.{side}_end_line) moved
from k_lines l where l.side = '{side}'
"""


def _moved_lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    moved = M.moved_constructs(code_bodies(spark, sf_dir).filter("name <> ''"), threshold=0.999999).filter("similarity = 1")
    lines = code_files(spark, sf_dir).select("path", F.posexplode(text_lines(f"{side}_content")).alias("p", "c")).select(
        "path", (F.col("p") + 1).cast("bigint").alias("line")
    )
    return M.moved_line(lines, moved, side).select("path", "line", F.col("moved").isNotNull().alias("moved"))


@query("moved_lines", _moved_lines_sql("old"))
def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the old version that went elsewhere."""
    return _moved_lines(spark, sf_dir, "old")


@query("moved_lines_new", _moved_lines_sql("new"))
def moved_lines_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the new version that came from elsewhere."""
    return _moved_lines(spark, sf_dir, "new")


@query(
    "code_constructs",
    """
select path, name, node_type, change_type, cast(line_start as bigint) line_start, cast(line_end as bigint) line_end from (
  select n.path, n.name, n.node_type, case when o.path is null then 'added' else 'modified' end change_type, n.start_line line_start, n.end_line line_end
  from k_regions n left join (select distinct path, name from k_regions where side = 'old' and level = 1) o on o.path = n.path and o.name = n.name
  where n.side = 'new' and n.level = 1 and n.name <> ''
  union all
  select path, name, node_type, 'deleted', start_line, end_line from k_regions o where side = 'old' and level = 1 and name <> ''
    and not exists (select 1 from k_regions n where n.side = 'new' and n.level = 1 and n.path = o.path and n.name = o.name)
)
""",
)
def code_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs found in both versions of the code, only in one, matched by name."""
    return S.match_constructs(O.with_regions(code_files(spark, sf_dir))).drop("old_size")


@query(
    "similar_bodies",
    """
select path, name, node_type, cast(level as bigint) level, cast(1 as bigint) nth, s.similarity
from k_similar s join (select path, name, node_type from k_regions where side = 'new') n using (path, name, node_type)
""",
)
def similar_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every construct's two bodies; constructs of one name pair by their order in the file."""
    bodies = code_bodies(spark, sf_dir).filter("name <> '' and body <> ''")
    keys = ["path", "name", "node_type", "level"]
    nth = F.row_number().over(Window.partitionBy("side", *keys).orderBy("start_line", "end_line")).cast("bigint")
    bodies = bodies.withColumn("nth", nth)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("body"))).alias(f"{side}_body")
    both = bodies.groupBy(*keys, "nth").agg(of("old"), of("new")).filter("old_body is not null and new_body is not null")
    return both.select(*keys, "nth", F.round(similarity.body_similarity("old_body", "new_body"), 6).alias("similarity"))


# --- summaries of the code's own constructs ------------------------------------------------------------------

cte(
    "k_entries",
    """
select path, o.line old_line, n.line new_line, case when g % 4 = 3 then 'comment' else 'semantic' end category
from (select * from k_lines where side = 'old') o left join (select * from k_lines where side = 'new') n using (path, g, seq)
where n.text is null or o.text <> n.text
""",
)
cte("k_old_top", "select * from k_regions where side = 'old' and level = 1 and name <> ''")
cte("k_new_top", "select * from k_regions where side = 'new' and level = 1 and name <> ''")
# The same rules as for the line blocks of the other files, over these regions and entries.
for _name in ("matched", "changed_lines", "construct_lines", "constructs", "construct_counts", "stats"):
    cte(f"k_{_name}", re.sub(r"\bd_", "k_", CTES[f"d_{_name}"]))


@query("code_summary", "select path, " + ", ".join(ALL_COUNTERS) + " from k_stats")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each file of the code, over its own constructs."""
    return S.file_summary(O.with_regions(code_files(spark, sf_dir, chunks=True)))


@query("code_changes", "select * from k_constructs")
def code_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed constructs of the code with their changed lines and category."""
    return S.changed_constructs(O.with_regions(code_files(spark, sf_dir, chunks=True)))
