"""Queries over the scalar functions, on document lines and revision pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions import similarity
from changelens.functions import text as X
from changelens.functions.spans import is_partial_change
from changelens.operators import entries as E
from changelens.plans.registry import cte, query
from changelens.plans.relations_sql import strip
from changelens.plans.revisions import files, path_of, table


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, a, b): each line and a version of it with other whitespace or text, by a cycle of ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_lines("text")).alias("p", "a"))
    rows = docs.select("doc_id", (F.col("p") + 1).cast("bigint").alias("n"), "a")
    k = F.pmod(F.col("doc_id") + F.col("n"), F.lit(10))
    a = F.when(k == 8, F.concat(F.lit("    "), F.col("a"))).when(k == 9, F.concat(F.lit("\t"), F.col("a"))).otherwise(F.col("a"))
    rows = rows.withColumn("a", a)
    b = (
        F.when(k == 0, F.concat(F.lit("\t"), F.col("a")))
        .when(k == 1, F.concat(F.lit("  "), F.col("a")))
        .when(k == 2, F.concat(F.col("a"), F.lit(" \t")))
        .when(k == 3, F.replace("a", F.lit(" "), F.lit("  ")))
        .when(k == 4, F.replace("a", F.lit(" "), F.lit("")))
        .when(k == 5, F.concat(F.col("a"), F.lit("!")))
        .when(k == 6, F.concat(F.lit("\r\x0b\f"), F.col("a")))
        .when(k == 7, "")
        .when(k == 8, F.trim("a"))
        .otherwise(F.trim(F.replace("a", F.lit("\t"), F.lit(""))))
    )
    return rows.withColumn("b", b)


cte(
    "x_lines",
    r"""
select doc_id, n, a, case k when 0 then concat(chr(9), a) when 1 then concat('  ', a) when 2 then concat(a, ' ', chr(9))
  when 3 then replace(a, ' ', '  ') when 4 then replace(a, ' ', '') when 5 then concat(a, '!') when 6 then concat(chr(13), chr(11), chr(12), a)
  when 7 then '' when 8 then trim(a, ' ') else trim(replace(a, chr(9), ''), ' ') end b
from (
  select doc_id, n, k, case k when 8 then concat('    ', a) when 9 then concat(chr(9), a) else a end a
  from (select doc_id, n, c a, (doc_id + n) % 10 k from d_lines)
)
""",
)


@query(
    "whitespace_functions",
    rf"""
select doc_id, n, {strip("a")} stripped, {strip("a")} = {strip("b")} equal_ws, {strip("b")} = '' blank,
  cast(length(b) - length(regexp_replace(b, '^[ \t\n\r\x0b\x0c]+', '')) as bigint) leading_spaces, cast(strlen({strip("b")}) as bigint) bytes
from x_lines
""",
)
def whitespace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select(
        "doc_id", "n",
        X.strip_whitespace("a").alias("stripped"),
        X.equal_ignoring_whitespace("a", "b").alias("equal_ws"),
        X.is_blank("b").alias("blank"),
        X.leading_whitespace("b").cast("bigint").alias("leading_spaces"),
        X.non_whitespace_bytes("b").cast("bigint").alias("bytes"),
    )


@query(
    "ws_change_type",
    r"""
select doc_id, n, case
  when contains(a, chr(9)) and not contains(b, chr(9)) then 'tabs converted to spaces'
  when not contains(a, chr(9)) and contains(b, chr(9)) then 'spaces converted to tabs'
  when rtrim(a, concat(' ', chr(9))) <> a and rtrim(b, concat(' ', chr(9))) = b then 'trailing whitespace removed'
  when rtrim(a, concat(' ', chr(9))) = a and rtrim(b, concat(' ', chr(9))) <> b then 'trailing whitespace added'
  when rtrim(a, concat(' ', chr(9))) <> a then 'trailing whitespace changed'
  when la < lb then 'indentation increased' when la > lb then 'indentation decreased' else 'whitespace changed' end change
from (select *, length(a) - length(regexp_replace(a, '^[ \t\n\r\x0b\x0c]+', '')) la,
  length(b) - length(regexp_replace(b, '^[ \t\n\r\x0b\x0c]+', '')) lb from x_lines)
""",
)
def ws_change_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "n", X.whitespace_change_type("a", "b").alias("change"))


_MARKS = ("/// ", "  //! ", "/** ", "\t/* ", "// ", " # ", "", "")


@query(
    "comment_type",
    """
select doc_id, n, case when m in (0, 1, 2) then 'doc' when m = 3 then 'block' when m in (4, 5) then 'line'
    when m = 7 then 'block' when starts_with(ltrim(a, ' '), '//') or starts_with(ltrim(a, ' '), '#') then 'line' else 'unknown' end kind,
  case when m in (0, 1, 2) then 'doc comment' when m in (3, 7) then 'block comment' when m in (4, 5) then 'line comment'
    when starts_with(ltrim(a, ' '), '//') or starts_with(ltrim(a, ' '), '#') then 'line comment' else 'comment' end label
from (select doc_id, n, c a, n % 8 m from d_lines)
""",
)
def comment_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_lines("text")).alias("p", "a"))
    n = (F.col("p") + 1).cast("bigint")
    mark = F.get(F.array(*[F.lit(m) for m in _MARKS]), F.pmod(n, F.lit(8)).cast("int"))
    line = F.concat(mark, F.col("a"), F.when(F.pmod(n, F.lit(8)) == 7, F.lit(" */ \t")).otherwise(F.lit("")))
    kind = X.comment_type(line)
    return docs.select("doc_id", n.alias("n"), kind.alias("kind"), X.comment_label(kind).alias("label"))


# --- analyses of one rule -------------------------------------------------------------------------------

cte(
    "x_sides",
    """
select path, pos, h, old_line is not null and not bare has_old, new_line is not null and not bare has_new,
  case when old_line is not null and not bare then old_text else '' end old_c, case when new_line is not null and not bare then new_text else '' end new_c
from d_entries
""",
)


@query(
    "comment_only",
    "select path, cast(pos as bigint) pos, h = 3 comment_only, has_new and h = 3 new_side_only from x_sides",
)
def comment_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diff_entries(files(spark, sf_dir)).select(
        "path", "pos",
        E.comment_only("old_changes", "new_changes").alias("comment_only"),
        E.all_comments("new_changes").alias("new_side_only"),
    )


@query(
    "whitespace_only",
    f"select path, cast(pos as bigint) pos, (old_c <> '' or new_c <> '') and {strip('old_c')} = {strip('new_c')} whitespace_only from x_sides",
)
def whitespace_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diff_entries(files(spark, sf_dir)).select(
        "path", "pos", E.whitespace_only("old_changes", "new_changes").alias("whitespace_only")
    )


@query(
    "comment_analysis",
    """
select path, cast(pos as bigint) pos, case when h = 3 then 'comment' else 'semantic' end category, cast(1 as double) confidence,
  case when h = 3 then 'comment modified' end details from x_sides
""",
)
def comment_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.diff_entries(files(spark, sf_dir))
    return rows.select("path", "pos", E.comment_analysis("old_changes", "new_changes").alias("r")).select("path", "pos", "r.*")


@query(
    "whitespace_analysis",
    f"""
select path, cast(pos as bigint) pos, case when details is null then 'semantic' else 'whitespace' end category, cast(1 as double) confidence, details
from (
  select path, pos, case
    when has_new and not has_old and {strip('new_c')} = '' then 'blank line added'
    when has_old and not has_new and {strip('old_c')} = '' then 'blank line removed'
    when has_old and has_new and {strip('old_c')} = {strip('new_c')} then case when length(new_c) > length(old_c) then 'indentation increased' else 'whitespace changed' end
    end details from x_sides
)
""",
)
def whitespace_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.diff_entries(files(spark, sf_dir))
    return rows.select("path", "pos", E.whitespace_analysis("old_changes", "new_changes").alias("r")).select("path", "pos", "r.*")


@query(
    "token_predicates",
    """
select event_id, event_type <> 'view' novel, event_type in ('click', 'purchase') semantic_token from events
""",
)
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": "normal", "click": "keyword", "purchase": "type_", "signup": "novel", "error": "tree_sitter_error"}
    kind = X.mapped("event_type", kinds)
    return table(spark, sf_dir, "events").select(
        "event_id", E.is_novel(kind).alias("novel"), E.is_semantic_highlight(kind).alias("semantic_token")
    )


@query(
    "is_partial_change",
    "select doc_id, n, c <> '' and (n % 3 <> 0 or n % 2 = 1) and n % 7 <> 0 partial_change from d_lines",
)
def partial_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_lines("text")).alias("p", "c"))
    n = (F.col("p") + 1).cast("bigint")
    start = F.when(F.pmod(n, F.lit(3)) == 0, 0).otherwise(1)
    end = F.octet_length("c") - F.when(F.pmod(n, F.lit(2)) == 1, 1).otherwise(0)
    span = F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit("").alias("content"), F.lit("novel").alias("highlight")
    )
    spans = F.filter(F.array(span), lambda _: F.pmod(n, F.lit(7)) != 0)
    return docs.select("doc_id", n.alias("n"), is_partial_change("c", spans).alias("partial_change"))


# --- escaping and formats ----------------------------------------------------------------------------------


@query(
    "json_escape",
    r"""
select doc_id, n, concat(replace(replace(replace(replace(a, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(13), '\r'), 'x') escaped, b round_trip from (
  select doc_id, n, a, concat(b, chr(10), '"\', chr(1)) b from x_lines
)
""",
)
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir)
    hard = F.concat("b", F.lit('\n"\\\x01'))
    return rows.select(
        "doc_id", "n",
        F.concat(X.json_escape("a"), F.lit("x")).alias("escaped"),
        X.json_unescape(X.json_escape(hard)).alias("round_trip"),
    )


@query(
    "shell_escape",
    r"""
select page_id, replace(replace(replace(replace(replace(html, '\', '\\'), '$', '\$'), '`', '\`'), '"', '\"'), '!', '\!') escaped from pages
""",
)
def shell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.shell_escape("html").alias("escaped"))


@query("base64_payload", "select item_id, base64(encode(text)) payload from benchmark")
def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        "item_id", X.base64_text("text").alias("payload")
    )


@query(
    "rstrip_eol",
    r"""
select doc_id, rtrim(concat(text, case doc_id % 3 when 0 then chr(10) when 1 then concat(chr(13), chr(10)) else ' ' end), concat(chr(10), chr(13))) trimmed from documents
""",
)
def rstrip_eol(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tails = F.get(F.array(F.lit("\n"), F.lit("\r\n"), F.lit(" ")), F.pmod("doc_id", F.lit(3)).cast("int"))
    return docs.select("doc_id", X.rstrip_eol(F.concat("text", tails)).alias("trimmed"))


@query("expand_tabs", "select doc_id, n, replace(b, chr(9), '    ') expanded from x_lines")
def expand_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "n", X.expand_tabs("b").alias("expanded"))


@query(
    "fixed_width_wrap",
    """
select doc_id, n, cast(i as bigint) piece, c[i * 76 + 1:i * 76 + 76] text
from (select doc_id, n, c, unnest(generate_series(0, greatest((length(c) + 75) // 76, 1) - 1)) i from d_lines)
""",
)
def fixed_width_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_lines("text")).alias("p", "c"))
    rows = docs.select("doc_id", (F.col("p") + 1).cast("bigint").alias("n"), F.posexplode(X.fixed_width_pieces("c", 76)).alias("i", "text"))
    return rows.select("doc_id", "n", F.col("i").cast("bigint").alias("piece"), "text")


@query(
    "region_body",
    """
select path, case when n > 2 then concat(array_to_string(l[3:least(n, 6)], chr(10)), case when n > 6 then chr(10) else '' end) end body
from (select path, string_split(text, chr(10)) l, len(string_split(text, chr(10))) n from d_docs)
""",
)
def region_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        path_of(F.col("doc_id")).alias("path"),
        X.region_body(X.text_lines("text"), F.lit(2), F.lit(6)).alias("body"),
    )


# --- syntax classes -------------------------------------------------------------------------------------------


def _sql_list(values: object) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


_KIND = (
    "case i % 6 when 0 then 'line_comment' when 1 then (['string_literal','float','type_identifier','builtin_identifier'])[i // 6 % 4 + 1] "
    "when 2 then (['+=','->','::',';','{','...','(('])[i // 6 % 7 + 1] when 3 then (['true','nil','identifier','call_expression'])[i // 6 % 4 + 1] "
    "else lower(words[i % len(words) + 1]) end"
)
cte(
    "x_kinds",
    f"""
select doc_id, {_KIND} kind from (
  select doc_id, doc_id % 997 i, regexp_extract_all(concat(text, ' x in is'), '[A-Za-z]+') words from documents
)
""",
)


def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind): grammar node kinds, for a third of the documents a word of the text (some are keywords)."""
    docs = table(spark, sf_dir, "documents")
    i = F.pmod("doc_id", F.lit(997))
    words = F.regexp_extract_all(F.concat("text", F.lit(" x in is")), F.lit("[A-Za-z]+"), F.lit(0))

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.call_function("div", i, F.lit(6)), F.lit(len(values))).cast("int"))

    kind = (
        F.when(i % 6 == 0, "line_comment")
        .when(i % 6 == 1, pick(["string_literal", "float", "type_identifier", "builtin_identifier"]))
        .when(i % 6 == 2, pick(["+=", "->", "::", ";", "{", "...", "(("]))
        .when(i % 6 == 3, pick(["true", "nil", "identifier", "call_expression"]))
        .otherwise(F.lower(F.get(words, F.pmod(i, F.size(words)).cast("int"))))
    )
    return docs.select("doc_id", kind.alias("kind"))


@query(
    "infer_highlight",
    f"""
select doc_id, kind, case when contains(kind, 'comment') then 'comment'
  when kind in ('string_literal') then 'string' when kind = 'float' then 'number' when kind = 'type_identifier' then 'type_'
  when kind = 'builtin_identifier' then 'function' when kind in ({_sql_list(schemas.KEYWORDS)}) then 'keyword'
  when kind in ('true', 'nil') then 'constant' when kind in ('+=', '->', '...', '::') then 'operator'
  when kind in (';', '{{') then 'punctuation' else 'none' end highlight
from x_kinds
""",
)
def infer_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_kinds(spark, sf_dir).select("doc_id", "kind", X.infer_highlight("kind").alias("highlight"))


@query(
    "construct_kind",
    """
select doc_id, language, node, case concat(language, '/', node)
  when 'rust/function_item' then 'function' when 'cpp/class_specifier' then 'class' when 'go/type_declaration' then 'struct_'
  when 'typescript/arrow_function' then 'function' when 'zig/TestDecl' then 'test_decl' when 'java/enum_declaration' then 'enum_' end kind
from (select doc_id, (['rust','cpp','go','typescript','zig','java','json'])[doc_id % 7 + 1] language,
  (['function_item','class_specifier','type_declaration','arrow_function','TestDecl','enum_declaration'])[doc_id % 6 + 1] node from documents)
""",
)
def construct_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("doc_id", F.lit(len(values))).cast("int"))

    rows = docs.select(
        "doc_id",
        pick(["rust", "cpp", "go", "typescript", "zig", "java", "json"]).alias("language"),
        pick(["function_item", "class_specifier", "type_declaration", "arrow_function", "TestDecl", "enum_declaration"]).alias("node"),
    )
    return rows.withColumn("kind", X.construct_kind("language", "node"))


@query(
    "node_tests",
    """
select doc_id, node, node like '%identifier%' identifier, node = 'variable_declaration' and child like '%eclaration' and child <> 'function_declaration' container
from (select doc_id, (['identifier','variable_declaration','type_identifier','call_expression','shorthand_property_identifier','number'])[doc_id % 6 + 1] node,
  (['struct_declaration','enum_declaration','function_declaration','string','error_set_declaration'])[doc_id % 5 + 1] child from documents)
""",
)
def node_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that hold an identifier, and declarations that hold a container."""

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("doc_id", F.lit(len(values))).cast("int"))

    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(["identifier", "variable_declaration", "type_identifier", "call_expression", "shorthand_property_identifier", "number"]).alias("node"),
        F.array(F.lit("const"), pick(["struct_declaration", "enum_declaration", "function_declaration", "string", "error_set_declaration"])).alias("children"),
    )
    tests = {"identifier": X.is_identifier_node("node"), "container": X.is_container_declaration("node", "children")}
    return rows.withColumns(tests).select("doc_id", "node", "identifier", "container")


@query(
    "blend_channel",
    "select doc_id, cast((6 * (n_chars % 256) + 4 * (doc_id % 256)) // 10 as bigint) channel from documents",
)
def blend_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.blend_channel(F.pmod("n_chars", F.lit(256)), F.pmod("doc_id", F.lit(256))).alias("channel"))


# --- similarity --------------------------------------------------------------------------------------------------


@query(
    "similarity_fast_path",
    f"""
select doc_id, n, case when {strip('a')} = {strip('b')} then cast(1 as double)
  when {strip('a')} = '' or {strip('b')} = '' then cast(0 as double) end similarity from x_lines
""",
)
def similarity_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "n", similarity.similarity_fast_path("a", "b").alias("similarity"))


# Row by row of the table: after i bytes of the shorter text, ends[k] is the least place in the other at which
# a common subsequence of length k can end. A further byte extends one of length k - 1 to its next occurrence.
_LCS_SQL = r"""
with recursive l_pairs as (
  select doc_id, n, case when strlen(a) < strlen(b) then a else b end s, case when strlen(a) < strlen(b) then b else a end t
  from (select doc_id, cast(n - 1 as bigint) n, regexp_replace(l[n], '[ \t\n\r\x0B\f]', '', 'g') a, regexp_replace(l[n + 1], '[ \t\n\r\x0B\f]', '', 'g') b
    from (select doc_id, l, unnest(range(1, len(l))) n from (select doc_id, string_split(text, chr(10)) l from documents)))
),
l_texts as materialized (
  select row_number() over () id, s, t, regexp_extract_all(hex(encode(s)), '..') sb, regexp_extract_all(hex(encode(t)), '..') tb
  from (select distinct s, t from l_pairs where s <> '' and s <> t)
),
l_places as (
  select id, c, len(tb) m, list_append(list_prepend(0, list_filter(range(1, len(tb) + 1), lambda p: tb[p] = c)), len(tb) + 1) q
  from (select id, tb, unnest(list_distinct(sb)) c from l_texts)
),
l_next as materialized (
  select id, c, list_append(flatten(list_transform(range(2, len(q) + 1), lambda k: list_resize([q[k]], q[k] - q[k - 1], q[k]))), m + 1) nx
  from l_places
),
l_ends as (
  select id, 0 i, cast([] as bigint[]) ends from l_texts
  union all
  select e.id, e.i + 1, list_filter(list_transform(range(1, len(e.ends) + 2), lambda k: least(coalesce(e.ends[k], len(x.tb) + 1), n.nx[coalesce(e.ends[k - 1], 0) + 1])), lambda p: p <= len(x.tb))
  from l_ends e join l_texts x on x.id = e.id join l_next n on n.id = e.id and n.c = x.sb[e.i + 1]
  where e.i < len(x.sb)
)
select p.doc_id, p.n, cast(case when p.s = p.t then strlen(p.s) when p.s = '' then 0 else len(e.ends) end as bigint) lcs
from l_pairs p left join l_texts x on x.s = p.s and x.t = p.t left join l_ends e on e.id = x.id and e.i = len(x.sb)
"""


@query("lcs_length", _LCS_SQL)
def lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common subsequence of each line with the next one of its document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.text_lines("text").alias("l"))
    pairs = docs.select(
        "doc_id",
        F.posexplode(F.transform("l", lambda c, i: F.struct(c.alias("a"), F.get("l", i + 1).alias("b")))).alias("n", "p"),
    ).filter("p.b is not null")
    return pairs.select("doc_id", F.col("n").cast("bigint").alias("n"), similarity.lcs_length("p.a", "p.b").alias("lcs"))


@query(
    "body_similarity",
    f"""
select doc_id, n, round(case when {strip('a')} = {strip('b')} then 1 when {strip('a')} = '' or {strip('b')} = '' then 0
  else cast(strlen({strip('a')}) as double) / strlen({strip('b')}) end, 6) similarity from x_lines
""",
)
def body_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each line and its variant; where the variant adds one mark, the line is all they share."""
    rows = lines_of(spark, sf_dir)
    return rows.select("doc_id", "n", F.round(similarity.body_similarity("a", "b"), 6).alias("similarity"))
