"""Scalar text functions: whitespace, comments, escaping, headers, labels. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import schemas

ASCII_SPACE = " \t\n\r\x0b\f"
_WS = r"[ \t\n\r\x0B\f]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(c: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    """Look a value up in a small fixed table; anything else gives ``default`` (null when not given)."""
    c = column(c)
    pairs = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")")
    hit = F.when(c.isNotNull(), pairs[c])
    return hit if default is None else F.coalesce(hit, default)


# --- whitespace -----------------------------------------------------------------------------


def strip_whitespace(c: Column | str) -> Column:
    return F.translate(column(c), ASCII_SPACE, "")


def equal_ignoring_whitespace(a: Column | str, b: Column | str) -> Column:
    return strip_whitespace(a) == strip_whitespace(b)


def is_blank(c: Column | str) -> Column:
    return strip_whitespace(c) == ""


def leading_whitespace(c: Column | str) -> Column:
    c = column(c)
    return F.length(c) - F.length(F.regexp_replace(c, f"^{_WS}+", ""))


def non_whitespace_bytes(c: Column | str) -> Column:
    return F.octet_length(strip_whitespace(c))


def whitespace_change_type(old: Column | str, new: Column | str) -> Column:
    """Name the first kind of whitespace difference that applies: tabs, trailing, indentation, other."""
    old, new = column(old), column(new)
    old_tab, new_tab = F.contains(old, F.lit("\t")), F.contains(new, F.lit("\t"))
    old_tail, new_tail = old.rlike(r"[ \t]\z"), new.rlike(r"[ \t]\z")
    old_lead, new_lead = leading_whitespace(old), leading_whitespace(new)
    return (
        F.when(old_tab & ~new_tab, "tabs converted to spaces")
        .when(~old_tab & new_tab, "spaces converted to tabs")
        .when(old_tail & ~new_tail, "trailing whitespace removed")
        .when(~old_tail & new_tail, "trailing whitespace added")
        .when(old_tail & new_tail, "trailing whitespace changed")
        .when(new_lead > old_lead, "indentation increased")
        .when(new_lead < old_lead, "indentation decreased")
        .otherwise("whitespace changed")
    )


def rstrip_eol(c: Column | str) -> Column:
    return F.regexp_replace(column(c), r"[\n\r]+\z", "")


def expand_tabs(c: Column | str, width: int = 4) -> Column:
    return F.replace(column(c), F.lit("\t"), F.lit(" " * width))


# --- comments -------------------------------------------------------------------------------


def comment_type(c: Column | str) -> Column:
    c = column(c)
    head = F.regexp_replace(c, r"^[ \t]+", "")
    return (
        F.when(head.startswith("///") | head.startswith("//!") | head.startswith("/**"), "doc")
        .when(head.startswith("/*"), "block")
        .when(head.startswith("//") | head.startswith("#"), "line")
        .when(F.regexp_replace(c, r"[ \t\n]+\z", "").endswith("*/"), "block")
        .otherwise("unknown")
    )


def comment_label(kind: Column | str) -> Column:
    return mapped(kind, schemas.COMMENT_LABELS)


# --- paths ----------------------------------------------------------------------------------


def extension(path: Column | str) -> Column:
    """Text after the last dot of the base name; null without a dot or when the name starts with its only dot."""
    base = F.element_at(F.split(column(path), "/"), -1)
    return F.nullif(F.regexp_extract(base, r"^.+\.([^.]*)$", 1), F.lit(""))


def language_of(path: Column | str) -> Column:
    return mapped(extension(path), schemas.EXTENSIONS)


# Fixed value: bytes that decide whether a file is binary.
SNIFF_BYTES = 8192


def is_binary(content: Column | str, sniff_bytes: int = SNIFF_BYTES) -> Column:
    """A NUL byte within the sniff window of a text."""
    head = F.substring(F.to_binary(column(content), F.lit("utf-8")), 1, sniff_bytes)
    return F.contains(head, F.to_binary(F.lit("00"), F.lit("hex")))


# --- escaping -------------------------------------------------------------------------------


def shell_escape(c: Column | str) -> Column:
    return F.regexp_replace(column(c), r'([$`\\"!])', r"\\$1")


def json_escape(c: Column | str) -> Column:
    c = F.replace(column(c), F.lit("\\"), F.lit("\\\\"))
    named = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    control = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in named}
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), {**named, **control}.items(), c)


def json_unescape(c: Column | str) -> Column:
    """Decode the inside of a JSON string literal, escapes of code points included."""
    return F.from_json(F.concat(F.lit('{"v":"'), column(c), F.lit('"}')), "v string")["v"]


def base64_text(c: Column | str) -> Column:
    """Standard alphabet on one line (the built-in breaks lines at 76 characters)."""
    return F.translate(F.base64(F.to_binary(column(c), F.lit("utf-8"))), "\r\n", "")


# --- unified diff headers and line references ------------------------------------------------


def hunk_header(line: Column | str) -> Column:
    """``@@ -a[,b] +c[,d]`` as a struct of four numbers (missing counts are 1), null when it is not one."""
    line = column(line)
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(line, pattern, i), F.lit("")), F.lit("1")).cast("bigint")

    return F.when(
        line.rlike(pattern),
        F.struct(
            part(1).alias("old_start"),
            part(2).alias("old_count"),
            part(3).alias("new_start"),
            part(4).alias("new_count"),
        ),
    )


def hunk_overlaps(new_start: Column, new_count: Column, start: Column, end: Column) -> Column:
    last = F.when(new_count == 0, new_start).otherwise(new_start + new_count - 1)
    return (new_start <= end) & (last >= start)


def line_ref(start: Column | str, end: Column | str) -> Column:
    start, end = column(start), column(end)
    return F.when(start == end, F.format_string("Line %d", start)).otherwise(
        F.format_string("Lines %d-%d", start, end)
    )


def construct_description(change_type: Column | str, name: Column | str, node_type: Column | str) -> Column:
    change_type = column(change_type)
    what = F.when(change_type == "modified", change_type).otherwise(mapped(node_type, schemas.NODE_LABELS))
    return F.format_string("%s %s (%s)", mapped(change_type, schemas.CHANGE_SYMBOLS), column(name), what)


def category_label(category: Column | str) -> Column:
    """Symbol and name of a change category."""
    return F.concat_ws(" ", mapped(category, schemas.CATEGORY_SYMBOLS), column(category))


def is_identifier_node(node: Column | str) -> Column:
    """A grammar's node that holds an identifier."""
    return F.coalesce(column(node).isin(*schemas.IDENTIFIER_NODES), F.lit(False))


def is_container_declaration(node: Column | str, children: Column | str) -> Column:
    """A variable declaration one of whose direct children is a container."""
    held = F.arrays_overlap(F.coalesce(column(children), F.array().cast("array<string>")), F.array(*map(F.lit, schemas.CONTAINER_NODES)))
    return F.coalesce((column(node) == "variable_declaration") & held, F.lit(False))


def line_change_summary(added: Column | str, deleted: Column | str) -> Column:
    return F.format_string("+%d -%d", column(added), column(deleted))


def ask_prompt(
    project: Column, path: Column, start: Column, end: Column, code: Column, question: Column, first: Column, last: Column
) -> Column:
    """A question about a code excerpt; of a long excerpt's parts the first has the heading and the last the question."""
    span = F.when(start == end, F.format_string("line %d", start)).otherwise(
        F.format_string("lines %d-%d", start, end)
    )
    heading = F.concat(F.lit("Review of "), project, F.lit(", "), path, F.lit(", "), span, F.lit("\n```\n"))
    ending = F.concat(F.lit("```\n\n"), question, F.lit("\n\nKeep the answer short."))
    return F.concat(F.when(first, heading).otherwise(""), code, F.when(last, ending).otherwise(""))


# --- lines and regions ------------------------------------------------------------------------


def text_lines(c: Column | str) -> Column:
    """Lines of a text; a trailing newline leaves one empty last line and '' is one empty line."""
    return F.split(column(c), "\n", -1)


def region_body(lines: Column | str, header_end: Column | str, end: Column | str) -> Column:
    """Lines after the header through the end line, each newline kept; null when there are none."""
    lines, header_end, end = column(lines), column(header_end).cast("int"), column(end).cast("int")
    last = F.least(end, F.size(lines))
    body = F.array_join(F.slice(lines, header_end + 1, last - header_end), "\n")
    body = F.when(last < F.size(lines), F.concat(body, F.lit("\n"))).otherwise(body)
    return F.when(last > header_end, F.nullif(body, F.lit("")))


def context_old_line(new_line: Column, offset: Column) -> Column:
    """Old number of a context line: new number minus the running offset, never below zero."""
    return F.greatest(new_line - offset, F.lit(0).cast("bigint"))


def fixed_width_pieces(c: Column | str, width: int) -> Column:
    """Pieces of at most ``width`` characters; an empty line is one empty piece."""
    c = column(c)
    count = F.greatest(F.ceil(F.length(c) / F.lit(width)), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * width + 1, F.lit(width))
    )


def blend_channel(base: Column, semantic: Column) -> Column:
    return F.floor((base * 6 + semantic * 4) / 10).cast("bigint")


# --- syntax classes -----------------------------------------------------------------------------


def infer_highlight(kind: Column | str) -> Column:
    """Highlight class of a grammar node kind; the first rule that applies wins."""
    k = column(kind)
    short = F.length(k).between(1, 3)
    first = F.substring(k, 1, 1)
    return (
        F.when(F.contains(k, F.lit("comment")), "comment")
        .when(k.isin(schemas.STRING_NODES), "string")
        .when(k.isin(schemas.NUMBER_NODES), "number")
        .when(k.isin(schemas.TYPE_NODES), "type_")
        .when(k == "builtin_identifier", "function")
        .when(k.isin(schemas.KEYWORDS), "keyword")
        .when(k.isin(schemas.CONSTANTS), "constant")
        .when(short & first.isin(list(schemas.OPERATOR_STARTS)), "operator")
        .when(k == "::", "operator")
        .when(k.isin(list(schemas.PUNCTUATION)), "punctuation")
        .otherwise("none")
    )


def construct_kind(language: Column | str, node: Column | str) -> Column:
    """Construct kind of a grammar node, null where the language has none for it."""
    family = mapped(language, schemas.NODE_FAMILY, column(language))
    table = {f"{lang}/{name}": kind for (lang, name), kind in schemas.CONSTRUCT_NODES.items()}
    return mapped(F.concat_ws("/", family, column(node)), table)
