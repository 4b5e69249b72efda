"""Source text as tokens: highlight spans and identifiers.

A small set of regular expressions stands in for a grammar: it knows comments, strings, numbers,
words, operators and punctuation of each language family. Tokens cover the text without gaps,
so byte positions are running lengths, computed in the file's row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import column, equal_ignoring_whitespace, infer_highlight, is_blank
from changelens.operators.barrier import bind, prefix_max, prefix_sum
from changelens.operators.scan import Fold, running

# Families with their own comment and string syntax. Possessive repeats are loops, so long literals stay off the stack.
_STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_REST = (
    r"[0-9][0-9A-Za-z_]*(?:\.[0-9][0-9A-Za-z_]*)?"
    r"|@?[\p{L}_][\p{L}\p{N}_]*"
    r"|\n|[ \t\r\f\x0B]+"
    r"|::|[-+*/%=!<>&|^~?.]{1,3}"
    r"|[\s\S]"
)
_LINE = r"//[^\n]*+"
_SLASH = rf"{_LINE}|/\*[\s\S]*?(?:\*/|\z)"
# Levels to which comments nest in languages where they do; deeper ones are text of the innermost.
NESTED_COMMENTS = 6


def _nested_comment(levels: int) -> str:
    inner = r"(?:[^*/]++|\*(?!/)|/)*+"
    for _ in range(levels - 1):
        inner = rf"(?:[^*/]++|\*(?!/)|/\*{inner}(?:\*/|\z)|/)*+"
    return rf"/\*{inner}(?:\*/|\z)"


_CHARACTER = r"'(?:[^'\\\n]|\\[^'\n]{1,10}|\\')'"
PATTERNS = {
    "python": rf'#[^\n]*+|"""[\s\S]*?(?:"""|\z)|\'\'\'[\s\S]*?(?:\'\'\'|\z)|{_STRING}'
    rf"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?|{_REST}",
    "script": rf"{_SLASH}|{_STRING}|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?|{_REST}",
    "brace": rf"{_SLASH}|{_STRING}|`[^`]*+`?|{_CHARACTER}|{_REST}",
    # A raw string ends at a quote with as many marks as it began with.
    "rust": rf"{_LINE}|{_nested_comment(NESTED_COMMENTS)}|b?r(#*)\"[\s\S]*?(?:\"\1|\z)|{_STRING}|{_CHARACTER}|{_REST}",
    "cpp": rf"{_SLASH}|(?:u8|[uUL])?R\"([^()\\\s]{{0,16}})\([\s\S]*?(?:\)\1\"|\z)|{_STRING}|{_CHARACTER}|{_REST}",
    "java": rf"{_SLASH}|\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\"|\z)|{_STRING}|{_CHARACTER}|{_REST}",
    # Lines of a string over several lines begin with two backslashes; comments have no end mark.
    "zig": rf"{_LINE}|\\\\[^\n]*+|{_STRING}|{_CHARACTER}|{_REST}",
}
# Family of each language that is read as source.
FAMILIES = {
    "python": "python",
    "javascript": "script",
    "typescript": "script",
    "zig": "zig",
    "rust": "rust",
    "go": "brace",
    "c": "brace",
    "cpp": "cpp",
    "java": "java",
}
# Names of built-in types.
PRIMITIVES = (
    "u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f16 f32 f64 f128 bool boolean byte char str void int "
    "long short float double unsigned signed size_t anyerror anytype noreturn comptime_int type"
).split()
# Reserved words without a highlight of their own; they are no identifiers either.
RESERVED = (
    "function elif except pass raise global nonlocal assert del extends implements instanceof delete throws "
    "typedef namespace template operator virtual friend using register auto final abstract synchronized fallthrough map"
).split()
_WORDS_THAT_ARE_NODES = ("null_literal", "boolean")


# Runs of tokens that neither are nor begin a comment or a string. A word before a quote or mark may be a raw string's prefix,
# and what begins with a slash may be a comment, so these end a run.
_RUN = (
    r"(?:[0-9][0-9A-Za-z_]*+(?:\.[0-9][0-9A-Za-z_]*+)?+|@?[\p{L}_][\p{L}\p{N}_]*+(?![\"'#])|[ \t\r\f\x0B\n]++"
    r"|[-+*%=!<>&|^~?.][-+*/%=!<>&|^~?.]{0,2}+|[(){}\[\],;:])++"
)


def pieces(content: Column | str, language: Column | str) -> Column:
    """The text as its comments, its strings and what is between them in one or more pieces; these are whole tokens."""
    return _cut(content, language, {name: pattern.replace(_REST, f"{_RUN}|{_REST}") for name, pattern in PATTERNS.items()})


def tokens(content: Column | str, language: Column | str) -> Column:
    """All tokens of a text, in order and without gaps; no tokens in languages that are not read as source."""
    return _cut(content, language, PATTERNS)


def _cut(content: Column | str, language: Column | str, patterns: dict[str, str]) -> Column:
    content, language = column(content), column(language)

    def family(name: str) -> Column:
        return language.isin([k for k, v in FAMILIES.items() if v == name])

    def cut(name: str) -> Column:
        return F.regexp_extract_all(content, F.lit(patterns[name]), F.lit(0))

    return (
        F.when(family("brace"), cut("brace"))
        .when(family("python"), cut("python"))
        .when(family("script"), cut("script"))
        .when(family("rust"), cut("rust"))
        .when(family("zig"), cut("zig"))
        .when(family("cpp"), cut("cpp"))
        .when(family("java"), cut("java"))
        .otherwise(F.array().cast("array<string>"))
    )


def is_comment(token: Column, language: Column) -> Column:
    hash_mark = token.startswith("#") & (language == "python")
    return hash_mark | ((token.startswith("//") | token.startswith("/*")) & (language != "python"))


def is_string(token: Column) -> Column:
    """A quoted token, a raw string with its prefix, or a line of a string over several lines."""
    prefixed = F.contains(token, F.lit('"')) & token.rlike(r'^(?:b?r#*"|(?:u8|[uUL])?R")')
    return F.substring(token, 1, 1).isin('"', "'", "`") | prefixed | token.startswith("\\\\")


def is_word(token: Column) -> Column:
    return token.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")


def is_identifier(token: Column) -> Column:
    """A word that is no keyword, constant, reserved word or built-in type."""
    return is_word(token) & ~token.isin(*schemas.KEYWORDS, *schemas.CONSTANTS, *PRIMITIVES, *RESERVED)


def token_highlight(token: Column, language: Column) -> Column:
    """Highlight class of a token; identifiers and blanks have none."""
    constants = [c for c in schemas.CONSTANTS if c not in _WORDS_THAT_ARE_NODES]
    return (
        F.when(is_comment(token, language), "comment")
        .when(is_string(token), "string")
        .when(F.substring(token, 1, 1).between("0", "9"), "number")
        .when(token.startswith("@") & token.rlike(r"^@[\p{L}_]"), "function")
        .when(token.isin(*schemas.KEYWORDS) & is_word(token), "keyword")
        .when(token.isin(*constants) & is_word(token), "constant")
        .when(token.isin(*PRIMITIVES) & is_word(token), "type_")
        .when(is_blank(token) | is_word(token), "none")
        .otherwise(infer_highlight(token))
    )


def by_side(files: DataFrame, sides: Sequence[str] = ("old", "new")) -> DataFrame:
    """(path, language, side, content): one row per version of each file."""
    cells = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_content").alias("content")) for s in sides]
    return files.select("path", "language", F.inline(F.array(*cells)))


def token_rows(files: DataFrame, side: str = "new") -> DataFrame:
    """(path, language, side, pos, token, start_byte, end_byte, line) of every token of one version."""
    content = f"{side}_content"
    df = bind(files.select("path", "language", content), tok=tokens(content, "language"))
    df = bind(
        df,
        ends=F.transform("tok", lambda t: F.octet_length(t).cast("bigint")),
        breaks=F.transform("tok", lambda t: (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("bigint")),
    )
    df = bind(df, ends=prefix_sum("ends"), breaks=prefix_sum("breaks"))
    rows = df.select("path", "language", F.posexplode(F.arrays_zip("tok", "ends", "breaks")).alias("pos", "x"))
    token = F.col("x.tok")
    inner = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
    return rows.select(
        "path",
        "language",
        F.lit(side).alias("side"),
        F.col("pos").cast("bigint").alias("pos"),
        token.alias("token"),
        (F.col("x.ends") - F.octet_length(token)).alias("start_byte"),
        F.col("x.ends").alias("end_byte"),
        (F.col("x.breaks") - inner + 1).alias("line"),
    )


def highlight_spans(files: DataFrame, side: str = "new") -> DataFrame:
    """Highlighted byte spans of one version of each file."""
    rows = token_rows(files, side).withColumn("highlight", token_highlight(F.col("token"), F.col("language")))
    return rows.filter("highlight <> 'none'").select("path", "side", "start_byte", "end_byte", "highlight")


def with_spans(files: DataFrame, side: str = "new") -> DataFrame:
    """(path, language, spans): (start_byte, end_byte, highlight) of every token of one version in order, in the file's row."""
    df = bind(files.select("path", "language", F.col(f"{side}_content").alias("content")), tok=tokens("content", "language")).drop("content")
    df = bind(df, ends=F.transform("tok", lambda t: F.octet_length(t).cast("bigint")))
    df = bind(df, ends=prefix_sum("ends"))

    def span(t: Column, i: Column) -> Column:
        end = F.get("ends", i)
        return F.struct((end - F.octet_length(t)).alias("start_byte"), end.alias("end_byte"), token_highlight(t, F.col("language")).alias("highlight"))

    return bind(df, spans=F.transform("tok", span)).drop("tok", "ends")


def highlights_at(df: DataFrame) -> DataFrame:
    """(path, byte_at, highlight): the highlight that covers each of a file's ``points``, null where none does.

    Points and starts of ``spans``, sorted together, carry the last span that has started. Spans do
    not overlap, so it is the only one that can cover the point.
    """

    def event(at: Column, tie: int, i: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), F.lit(tie).alias("tie"), i.cast("int").alias("i"))

    starts = F.transform("spans", lambda x, i: event(x["start_byte"], 0, i))
    df = bind(df, _events=F.sort_array(F.concat(starts, F.transform("points", lambda p, i: event(p, 1, i)))))
    df = bind(df, _last=F.transform("_events", lambda e: F.when(e["tie"] == 0, e["i"]).otherwise(-1)))
    df = bind(df, _last=prefix_max("_last"))

    def answer(e: Column, k: Column) -> Column:
        span = F.get("spans", F.get("_last", k))
        shown = (e["at"] < span["end_byte"]) & (span["highlight"] != "none")
        return F.when(e["tie"] == 1, F.struct(e["at"].alias("byte_at"), F.when(shown, span["highlight"]).alias("highlight")))

    return df.select("path", F.inline(F.array_compact(F.transform("_events", answer))))


# --- identifiers of a short text, in its row ------------------------------------------------------------


def identifiers(content: Column | str, language: Column | str) -> Column:
    """Identifiers in order of appearance."""
    return F.filter(tokens(content, language), is_identifier)


def normalized(content: Column | str, language: Column | str) -> Column:
    """A short text with each identifier replaced by ``_id0``, ``_id1``, … by first appearance."""

    def rewrite(tok: Column) -> Column:
        def with_names(names: Column) -> Column:
            return F.array_join(
                F.transform(
                    tok,
                    lambda t: F.when(
                        is_identifier(t), F.concat(F.lit("_id"), (F.array_position(names, t) - 1).cast("string"))
                    ).otherwise(t),
                ),
                "",
            )

        return F.transform(F.array(F.array_distinct(F.filter(tok, is_identifier))), with_names)[0]

    return F.transform(F.array(tokens(content, language)), rewrite)[0]


def is_rename(old: Column | str, new: Column | str, language: Column | str) -> Column:
    """The texts differ in more than whitespace, but only by which names they use.

    Names and what stands for them are letters, digits and underscores, so texts that differ in
    anything else are settled without their tokens.
    """
    old, new, language = column(old), column(new), column(language)
    rest = lambda c: F.regexp_replace(c, r"[\p{L}\p{N}_]+", "")
    able = language.isin(*FAMILIES) & ~equal_ignoring_whitespace(old, new) & equal_ignoring_whitespace(rest(old), rest(new))
    alike = equal_ignoring_whitespace(normalized(old, language), normalized(new, language))
    return F.coalesce(F.when(able, alike), F.lit(False))


def rename_analysis(old: Column | str, new: Column | str, language: Column | str) -> Column:
    """struct(category, confidence, old_name, new_name) of a pair of texts; the first changed name is shown."""
    old, new, language = column(old), column(new), column(language)
    # Bound, so that each part is computed once, and names only where they are shown.
    renamed = (old != "") & (new != "") & is_rename(old, new, language)

    def first_pair(ids: Column) -> Column:
        pairs = F.zip_with(ids["old"], ids["new"], lambda x, y: F.struct(x.alias("old"), y.alias("new")))
        return F.when(F.size(ids["old"]) == F.size(ids["new"]), F.get(F.filter(pairs, lambda p: p["old"] != p["new"]), F.lit(0)))

    ids = F.struct(identifiers(old, language).alias("old"), identifiers(new, language).alias("new"))

    def result(r: Column) -> Column:
        first = F.get(F.transform(F.array(ids), first_pair), F.lit(0))
        return F.transform(F.array(F.struct(r.alias("renamed"), F.when(r, first).alias("first"))), described)[0]

    def described(x: Column) -> Column:
        first = x["first"]
        return F.struct(
            F.when(x["renamed"], "rename").otherwise("semantic").alias("category"),
            F.when(x["renamed"] & first["old"].isNull(), F.lit(0.9)).otherwise(F.lit(1.0)).alias("confidence"),
            first["old"].alias("old_name"),
            first["new"].alias("new_name"),
        )

    return F.transform(F.array(renamed), result)[0]


# --- identifiers of whole files ----------------------------------------------------------------------------


def identifier_rows(files: DataFrame, side: str = "new") -> DataFrame:
    return token_rows(files, side).filter(is_identifier(F.col("token"))).withColumnRenamed("token", "name")


def rename_map(files: DataFrame) -> DataFrame:
    """(path, old_name, new_name, count, first_at): names that differ at the same place in both versions.

    Places are matched one by one, and only where both versions hold equally many identifiers.
    """
    df = bind(
        files.select("path", "language", "old_content", "new_content"),
        a=identifiers("old_content", "language"),
        b=identifiers("new_content", "language"),
    ).filter(F.size("a") == F.size("b"))
    rows = df.select("path", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).filter("p.a <> p.b")
    return rows.groupBy("path", F.col("p.a").alias("old_name"), F.col("p.b").alias("new_name")).agg(
        F.count(F.lit(1)).alias("count"), F.min("at").cast("bigint").alias("first_at")
    )


def placeholder_ids(files: DataFrame, side: str = "new") -> DataFrame:
    """(path, name, id): the number of each identifier, by first appearance in its file."""
    first = identifier_rows(files, side).groupBy("path", "name").agg(F.min("pos").alias("pos"))
    ranked = running(first, ["path"], "pos", [Fold("id", F.lit(1).cast("bigint"))])
    return ranked.select("path", "name", (F.col("id") - 1).alias("id"))


def normalized_files(files: DataFrame, side: str = "new") -> DataFrame:
    """(path, normalized): whole files with each identifier replaced by its number.

    Numbers are found by sorting inside the row: by name to reach each name's first place, by
    first place to count names, and back by place.
    """
    df = bind(by_side(files, [side]), tok=tokens("content", "language")).drop("content")
    df = bind(df, word=F.transform("tok", lambda t: F.when(is_identifier(t), 1).otherwise(0)))
    df = bind(
        df,
        nth=prefix_sum("word"),
        used=F.sort_array(
            F.filter(
                F.zip_with(
                    "word",
                    F.transform("tok", lambda t, i: F.struct(t.alias("name"), i.alias("at"))),
                    lambda w, x: F.struct(x["name"].alias("name"), x["at"].alias("at"), w.alias("w")),
                ),
                lambda x: x["w"] == 1,
            )
        ),
    )
    df = bind(
        df,
        head=F.transform(
            "used", lambda x, i: F.when((i == 0) | (x["name"] != F.get("used", i - 1)["name"]), i).otherwise(-1)
        ),
    )
    df = bind(df, head=prefix_max("head"))
    df = bind(
        df,
        used=F.sort_array(
            F.transform("used", lambda x, i: F.struct(F.get("used", F.get("head", i))["at"].alias("first"), x["at"].alias("at")))
        ),
    )
    df = bind(
        df,
        number=F.transform(
            "used", lambda x, i: F.when((i == 0) | (x["first"] != F.get("used", i - 1)["first"]), 1).otherwise(0)
        ),
    )
    df = bind(df, number=prefix_sum("number"))
    df = bind(
        df,
        used=F.sort_array(
            F.transform("used", lambda x, i: F.struct(x["at"].alias("at"), (F.get("number", i) - 1).alias("id")))
        ),
    )
    text = F.transform(
        "tok",
        lambda t, i: F.when(
            F.get("word", i) == 1, F.concat(F.lit("_id"), F.get("used", F.get("nth", i) - 1)["id"].cast("string"))
        ).otherwise(t),
    )
    return df.select("path", F.array_join(text, "").alias("normalized"))
