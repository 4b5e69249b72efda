"""Find the collapsible regions of source files.

Without a grammar, constructs are recognised statement by statement: comments and strings are
blanked, lines inside round or square brackets of an earlier line are joined to it, a header pattern
names the construct, and its body runs from where its nesting level opens to where it closes again. Levels come from braces, in Python from indentation. This approximates the
node boundaries of a parser; languages without header patterns have no regions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import column, text_lines
from changelens.operators.barrier import bind, prefix_max, prefix_sum
from changelens.operators.scan import whole
from changelens.operators.source_code import FAMILIES, by_side, is_comment, is_string, pieces

MAX_LEVEL = 3
INDENT = 4

_SCRIPT_HEADERS = [
    ("function", r"^\s*(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"^\s*interface\s+(\w+)"),
    ("function", r"^\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?!(?:if|for|while|switch|catch|return)\b)(\w+)\s*\([^;]*\)[^;]*\{\s*$"),
]
_C_HEADERS = [
    ("struct_", r"^\s*(?:typedef\s+)?struct\s+(\w+)[^;()]*$"),
    ("enum_", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)[^;()]*$"),
    ("union_", r"^\s*(?:typedef\s+)?union\s+(\w+)[^;()]*$"),
    ("class", r"^\s*class\s+(\w+)[^;()]*$"),
    ("function", r"^(?!\s*(?:if|for|while|switch|return|else|do)\b)[\w\s*&:<>,~]*?\b(\w+)\s*\([^;]*$"),
]
# Header line patterns per language, the first match wins. Group 1 is the name.
HEADERS = {
    "zig": [
        ("function", r"^\s*(?:pub\s+|export\s+|extern\s+|inline\s+|noinline\s+)*fn\s+(\w+)"),
        ("struct_", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union|error)\b"),
        ("test_decl", r"^\s*test\b\s*(\w*)"),
    ],
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(\w+)"),
        ("struct_", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
        ("enum_", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
        ("impl", r"^\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
        ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"),
    ],
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": _SCRIPT_HEADERS,
    "typescript": _SCRIPT_HEADERS,
    "go": [
        ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
        ("struct_", r"^type\s+(\w+)"),
    ],
    "c": _C_HEADERS,
    "cpp": _C_HEADERS,
    "java": [
        ("class", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*class\s+(\w+)"),
        ("interface", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*interface\s+(\w+)"),
        ("enum_", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*enum\s+(\w+)"),
        ("function", r"^\s+(?!(?:if|for|while|switch|catch|return|else|new)\b)[\w\s<>\[\],.@]*?\b(\w+)\s*\([^;]*$"),
    ],
}


def _headers() -> Column:
    """For each line of ``joined``: struct(kind, name) of a header, else null."""

    def cases(patterns: list[tuple[str, str]]) -> str:
        return " ".join(
            f"when c rlike r'{pattern}' then named_struct('kind', '{kind}', 'name', regexp_extract(c, r'{pattern}', 1))"
            for kind, pattern in patterns
        )

    by_language = " ".join(f"when '{lang}' then transform(joined, c -> case {cases(p)} end)" for lang, p in HEADERS.items())
    return F.expr(f"case language {by_language} else transform(joined, c -> cast(null as struct<kind:string,name:string>)) end")


def _nesting(braces: Column) -> Column:
    """struct(cur, low) of a line's braces: net change and lowest point on the way."""

    def step(acc: Column, b: Column) -> Column:
        cur = acc["cur"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)
        return F.struct(cur.alias("cur"), F.least(acc["low"], cur).alias("low"))

    return F.aggregate(F.split(braces, ""), _level(0, 0), step)


def _level(cur: int, low: int) -> Column:
    return F.struct(F.lit(cur).alias("cur"), F.lit(low).alias("low"))


def _with_statements(df: DataFrame) -> DataFrame:
    """Add, for each line of ``text``: ``goes_on``, whether it continues an earlier line's statement, and ``joined``, a statement on its first line.

    A line goes on where the innermost bracket open at its start is round or square; in Python any
    bracket will do. Brackets get the level they open; sorted by level and place, the innermost one
    open at a line's start is the latest opening before it. A text in which every line closes its
    brackets has nothing to sort.
    """
    python = F.col("language") == "python"
    # Pairs inside a line enclose no line's start; three levels of them go right away.
    left = F.transform("text", lambda c: F.when(c.rlike(r"[()\[\]{}]"), F.regexp_replace(c, r"[^()\[\]{}]", "")).otherwise(""))
    for _ in range(3):
        left = F.transform(left, lambda b: F.when(F.length(b) > 1, F.regexp_replace(b, r"\(\)|\[\]|\{\}", "")).otherwise(b))
    df = bind(df, brackets=left)
    reaches = F.exists("brackets", lambda b: b.rlike(r"[(\[]") | (python & F.contains(b, F.lit("{"))))
    signs = F.split(F.array_join(F.transform("brackets", lambda b: F.concat(F.lit("\n"), b)), ""), "")
    df = bind(df, sign=F.when(reaches, signs).otherwise(F.array().cast("array<string>"))).drop("brackets")
    opens = lambda c: c.isin("(", "[", "{")
    step = F.transform("sign", lambda c: F.when(opens(c), 1).when(c == "\n", 0).otherwise(-1).cast("bigint"))
    df = bind(df, level=step)
    df = bind(df, level=prefix_sum("level"))
    places = F.transform("sign", lambda c, i: F.struct(F.get("level", i).alias("level"), i.alias("at"), c.alias("sign")))
    df = bind(df, places=F.sort_array(F.filter(places, lambda x: opens(x["sign"]) | (x["sign"] == "\n"))))
    df = bind(df, opening=F.transform("places", lambda x, i: F.when(opens(x["sign"]), i).otherwise(-1)))
    df = bind(df, opening=prefix_max("opening"))

    def line_start(x: Column, i: Column) -> Column:
        around = F.get("places", F.get("opening", i))
        inside = (around["level"] == x["level"]) & (python | (around["sign"] != "{"))
        return F.when(x["sign"] == "\n", F.struct(x["at"].alias("at"), F.coalesce(inside, F.lit(False)).alias("inside")))

    starts = F.sort_array(F.array_compact(F.transform("places", line_start)))
    df = bind(df, goes_on=F.transform(starts, lambda x: x["inside"])).drop("sign", "level", "places", "opening")
    # From the end: the least line from each one on that begins a statement, negated.
    df = bind(df, upto=F.reverse(F.transform("goes_on", lambda x, i: -F.when(x, F.size("goes_on")).otherwise(i))))
    df = bind(df, upto=prefix_max("upto"))
    df = bind(df, upto=F.transform(F.reverse("upto"), lambda x: -x))

    def joined(c: Column, i: Column) -> Column:
        several = F.array_join(F.slice("text", i + 1, F.get("upto", i + 1) - i), " ")
        return F.when(_flag("goes_on", i), "").when(_flag("goes_on", i + 1), several).otherwise(c)

    return bind(df, joined=F.transform("text", joined))


def _flag(flags: str, i: Column) -> Column:
    return F.coalesce(F.get(flags, i), F.lit(False))


def _with_code_lines(df: DataFrame, bodies: bool) -> DataFrame:
    """Replace ``content`` by ``code`` (and the text's ``lines`` with ``bodies``): lines without comments and the inside of strings, with the levels they open and close.

    ``closes``/``opens`` are [from, to) level ranges and ``close_end`` is the line on which a
    region closed here ends. Only lines that change a level or hold a header are kept.
    """
    whole_lines = {"lines": text_lines("content")} if bodies else {}
    df = bind(df, tok=pieces("content", "language"), **whole_lines)

    # Line breaks inside comments and strings stay, so that line numbers do; a string leaves its quote.
    def blanked(t: Column) -> Column:
        breaks = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"[^\n]+", "")).otherwise("")
        return F.when(is_comment(t, F.col("language")), breaks).when(is_string(t), F.concat(F.lit('"'), breaks)).otherwise(t)

    df = bind(df, text=F.split(F.array_join(F.transform("tok", blanked), ""), "\n", -1)).drop("tok", "content")
    df = _with_statements(df)
    braces = lambda c: F.contains(c, F.lit("{")) | F.contains(c, F.lit("}"))
    nest = lambda c: F.when(braces(c), _nesting(F.regexp_replace(c, r"[^{}]", ""))).otherwise(_level(0, 0))
    python = F.col("language") == "python"
    df = bind(df, header=_headers(), nest=F.when(~python, F.transform("text", nest)))

    # Levels change on these lines only, so running sums go over them and not over all lines.
    def telling(c: Column, i: Column) -> Column:
        nest = F.get("nest", i)
        tells = (c != "") & (F.get("header", i).isNotNull() | (nest["cur"] != 0) | (nest["low"] != 0))
        return F.when(tells, F.struct(i.alias("at"), nest.alias("nest")))

    df = bind(df, told=F.when(~python, F.array_compact(F.transform("text", telling))).otherwise(F.array())).drop("nest")
    df = bind(df, depth=F.transform("told", lambda x: x["nest"]["cur"].cast("bigint")))
    df = bind(df, depth=prefix_sum("depth"))

    def brace_line(x: Column, k: Column) -> Column:
        i, nest = x["at"], x["nest"]
        before = F.get("depth", k) - nest["cur"]
        low = before + nest["low"]
        return F.struct(
            (i + 1).cast("bigint").alias("line"),
            F.get("text", i).alias("text"),
            F.get("joined", i).alias("joined"),
            F.get("header", i).alias("header"),
            before.alias("depth"),
            low.alias("close_from"),
            before.alias("close_to"),
            (i + 1).cast("bigint").alias("close_end"),
            low.alias("open_from"),
            F.get("depth", k).alias("open_to"),
            F.lit(None).cast("bigint").alias("next_line"),
        )

    def indented(c: Column, i: Column) -> Column:
        wide = F.replace(F.regexp_extract(c, r"^[ \t]*", 0), F.lit("\t"), F.lit(" " * INDENT))
        return F.struct(
            (i + 1).cast("bigint").alias("line"),
            F.when(_flag("goes_on", i + 1), F.get("upto", i + 1)).otherwise(i + 1).cast("bigint").alias("last"),
            c.alias("text"),
            F.get("joined", i).alias("joined"),
            F.get("header", i).alias("header"),
            whole(F.length(wide), INDENT).alias("depth"),
            _flag("goes_on", i).alias("goes_on"),
        )

    shown = lambda x: ~x["goes_on"] & ~F.trim(x["text"], F.lit(" \t\r\f")).isin("")
    filled = F.filter(F.transform("text", indented), shown)
    # A line after the end closes whatever is still open.
    ending = F.struct(
        (F.size("text") + 1).cast("bigint").alias("line"),
        (F.size("text") + 1).cast("bigint").alias("last"),
        F.lit("").alias("text"),
        F.lit("").alias("joined"),
        F.get("header", F.lit(-1)).alias("header"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(False).alias("goes_on"),
    )
    df = bind(df, filled=F.when(python, F.concat(filled, F.array(ending))).otherwise(F.slice(F.array(ending), 1, 0)))

    def indent_line(x: Column, i: Column) -> Column:
        before = F.get("filled", i - 1)
        level = F.coalesce(before["depth"], F.lit(0).cast("bigint"))
        line = F.struct(
            x["line"].alias("line"),
            x["text"].alias("text"),
            x["joined"].alias("joined"),
            x["header"].alias("header"),
            x["depth"].alias("depth"),
            F.least(x["depth"], level).alias("close_from"),
            level.alias("close_to"),
            F.coalesce(before["last"], F.lit(0).cast("bigint")).alias("close_end"),
            F.least(x["depth"], level).alias("open_from"),
            x["depth"].alias("open_to"),
            F.get("filled", i + 1)["line"].alias("next_line"),
        )
        return F.when(x["header"].isNotNull() | (x["depth"] != level), line)

    by_indent = F.array_compact(F.transform("filled", indent_line))
    by_brace = F.transform("told", brace_line)
    code = F.when(python, by_indent).otherwise(by_brace)
    return bind(df, code=code).drop("text", "joined", "goes_on", "upto", "header", "told", "depth", "filled")


_MARK = (
    "struct<depth:bigint,up:bigint,step:int,line:bigint,opens:bigint,at_start:boolean,closes:bigint,"
    "kind:string,name:string,next_line:bigint>"
)


def _mark(x: Column, depth: Column, step: int, **more: Column) -> Column:
    """An opening (step 0), header (1) or closing (2) of a level. Ordered from the last line up."""
    names = {"opens": "bigint", "at_start": "boolean", "closes": "bigint", "kind": "string", "name": "string", "next_line": "bigint"}
    return F.struct(
        depth.cast("bigint").alias("depth"),
        (-x["line"]).alias("up"),
        F.lit(step).alias("step"),
        x["line"].alias("line"),
        *[(more.get(n, F.lit(None))).cast(t).alias(n) for n, t in names.items()],
    ).cast(_MARK)


def _levels(start: Column, end: Column) -> Column:
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def body_of(lines: Column | str, header_end: Column, end: Column) -> Column:
    """The lines after a header up to ``end``, each with its newline (which the last line of a text lacks)."""
    lines = column(lines)
    piece = F.array_join(F.slice(lines, (header_end + 1).cast("int"), (end - header_end).cast("int")), "\n")
    return F.when(end > header_end, F.concat(piece, F.when(end < F.size(lines), "\n").otherwise(""))).otherwise("")


def _nested(df: DataFrame, bodies: bool = False) -> DataFrame:
    """Replace ``content`` by ``direct``: the spans of constructs directly inside other constructs (and ``lines`` with ``bodies``)."""
    python = F.col("language") == "python"

    def marks_of(x: Column) -> Column:
        header = x["header"]
        braces = F.contains(x["joined"], F.lit("{"))
        # A body that closes on the header's own line, or a declaration without one.
        complete = (braces & (x["joined"] == x["text"]) & (x["open_from"] == x["open_to"])) | (
            ~braces & F.regexp_replace(x["joined"], r"\s+$", "").endswith(";")
        )
        is_header = header.isNotNull() & (python | ~complete)
        return F.concat(
            F.transform(
                _levels(x["open_from"], x["open_to"]),
                lambda v: _mark(x, v, 0, opens=x["line"], at_start=x["text"].startswith("{")),
            ),
            F.filter(
                F.array(_mark(x, x["depth"], 1, kind=header["kind"], name=header["name"], next_line=x["next_line"])),
                lambda _: is_header,
            ),
            F.transform(_levels(x["close_from"], x["close_to"]), lambda v: _mark(x, v, 2, closes=x["close_end"])),
        )

    df = _with_code_lines(df, bodies)
    # Sorted by level and then from the last line up, the nearest opening and closing at or below
    # a header are the latest ones before it in the array.
    df = bind(df, marks=F.sort_array(F.flatten(F.transform("code", marks_of)))).drop("code")
    df = bind(
        df,
        open_at=F.transform("marks", lambda m, i: F.when(m["step"] == 0, i).otherwise(-1)),
        close_at=F.transform("marks", lambda m, i: F.when(m["step"] == 2, i).otherwise(-1)),
    )
    df = bind(df, open_at=prefix_max("open_at"), close_at=prefix_max("close_at"))

    def span(m: Column, i: Column) -> Column:
        opening, closing = F.get("marks", F.get("open_at", i)), F.get("marks", F.get("close_at", i))
        first = F.when(opening["depth"] == m["depth"], opening["opens"])
        last = F.when(closing["depth"] == m["depth"], closing["closes"])
        header_end = F.greatest(F.when(python | opening["at_start"], first - 1).otherwise(first), m["line"])
        whole_body = (m["step"] == 1) & (last > m["line"]) & (first <= last) & (~python | (first == m["next_line"]))
        return F.when(
            whole_body,
            F.struct(
                m["line"].alias("start_line"), last.alias("end_line"), header_end.alias("header_end_line"),
                m["kind"].alias("node_type"), m["name"].alias("name"), m["depth"].alias("depth"),
            ),
        )

    df = bind(df, spans=F.array_compact(F.transform("marks", span))).drop("marks", "open_at", "close_at")

    # How many regions enclose a header: starts above it minus ends above it.
    def visits(s: Column) -> Column:
        def visit(at: Column, tie: int, n: int) -> Column:
            return F.struct(at.alias("at"), F.lit(tie).alias("tie"), F.lit(n).cast("bigint").alias("n"), s.alias("span"))

        return F.array(visit(s["start_line"], 0, 0), visit(s["start_line"], 1, 1), visit(s["end_line"], 2, -1))

    df = bind(df, visits=F.sort_array(F.flatten(F.transform("spans", visits))))
    df = bind(df, inside=F.transform("visits", lambda v: v["n"]))
    df = bind(df, inside=prefix_sum("inside"))
    direct = F.filter(
        F.transform(
            "visits",
            lambda v, i: F.struct(v["tie"].alias("tie"), v["span"].alias("span"), F.get("inside", i).alias("inside")),
        ),
        lambda v: (v["tie"] == 0) & (v["inside"] == v["span"]["depth"]) & (v["inside"] < MAX_LEVEL),
    )
    return bind(df, direct=direct).drop("visits", "inside", "spans")


def with_regions(files: DataFrame) -> DataFrame:
    """Add ``regions``, those of both versions as one array, to each file: no version is a row of its own, so nothing meets again."""
    df = files
    for side in ("old", "new"):
        df = _nested(df.withColumn("content", F.coalesce(F.col(f"{side}_content"), F.lit(""))))

        def region(v: Column) -> Column:
            span = v["span"]
            return F.struct(
                F.lit(side).alias("side"),  # noqa: B023
                *[span[c].alias(c) for c in ("start_line", "end_line", "header_end_line", "node_type", "name")],
                F.lit(True).alias("collapsed"),
                (span["depth"] + 1).alias("level"),
            )

        df = bind(df, **{f"_{side}_regions": F.transform("direct", region)}).drop("direct")
    return bind(df, regions=F.concat("_old_regions", "_new_regions")).drop("_old_regions", "_new_regions")


def find_regions(files: DataFrame, sides: Sequence[str] = ("old", "new"), bodies: bool = False) -> DataFrame:
    """Regions of the versions of each file (see schemas.REGIONS), all collapsed.

    Only constructs directly inside other constructs nest, down to three levels, and those on a
    single line are left out. A file is worked on in its row, so this needs no shuffle. With
    ``bodies`` there is a column ``body``, the text after the header, cut from the row as well.
    """
    df = _nested(by_side(files.filter(F.col("language").isin(*FAMILIES)), sides), bodies)
    direct = F.col("direct")
    if bodies:

        def with_body(v: Column) -> Column:
            span = v["span"]
            return F.struct(span.alias("span"), body_of("lines", span["header_end_line"], span["end_line"]).alias("body"))

        direct = F.transform(direct, with_body)
    rows = df.select("path", "side", F.explode(direct).alias("v"))
    return rows.select(
        "path",
        "side",
        "v.span.start_line",
        "v.span.end_line",
        "v.span.header_end_line",
        "v.span.node_type",
        "v.span.name",
        F.lit(True).alias("collapsed"),
        (F.col("v.span.depth") + 1).alias("level"),
        *([F.col("v.body").alias("body")] if bodies else []),
    )
