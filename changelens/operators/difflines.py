"""Unified and side-by-side rows of a file's changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.spans import change_ranges, effective_changes, is_partial_change
from changelens.functions.text import context_old_line, text_lines
from changelens.operators.barrier import bind, prefix_max, prefix_sum
from changelens.operators.entries import category, with_entry_array

_CHANGES = f"array<{schemas.CHANGE}>"


def with_running_state(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, entries, offset, gap_after): entries with the state carried from one to the next.

    * ``offset`` after each entry: new minus old line number. A shown modification sets it, a
      deletion lowers it and an addition raises it by one; skipped pairs leave it alone.
    * ``gap_after``: unchanged old lines are left out before a next chunk that only deletes.
      Decided by the last old line shown, which context rows set and entries only raise.
    """

    def both(x: Column) -> Column:
        return x["old_line"].isNotNull() & x["new_line"].isNotNull()

    def step(x: Column) -> Column:
        one = F.when(x["old_line"].isNull(), 1).when(x["new_line"].isNull(), -1).otherwise(0)
        return one.cast("bigint")

    df = bind(
        with_entry_array(files, keep=keep),
        steps=F.transform("entries", step),
        # Position of the last shown modification up to each entry, -1 before the first.
        jumps=F.transform("entries", lambda x, i: F.when(both(x) & ~_same(x), i).otherwise(F.lit(-1))),
    )
    df = bind(df, steps=prefix_sum("steps"), jumps=prefix_max("jumps"))

    def offset(jump: Column, i: Column) -> Column:
        at = F.get("entries", jump)
        since = F.get("steps", i) - F.coalesce(F.get("steps", jump), F.lit(0).cast("bigint"))
        return since + F.coalesce(at["new_line"] - at["old_line"], F.lit(0).cast("bigint"))

    df = bind(df.drop("x"), offset=F.transform("jumps", offset))

    def mark(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("offset", i - 1), F.lit(0).cast("bigint"))
        old = F.coalesce(x["old_line"], F.lit(0).cast("bigint"))
        lead, gap, trail = (F.size(x[c]["texts"]) for c in ("lead", "gap", "trail"))
        filled = F.when(gap > 0, x["gap"]["start"] + gap - 1).otherwise(x["lead"]["start"] + lead - 1)
        from_fill = F.greatest(context_old_line(filled, before), old)
        from_trail = context_old_line(x["trail"]["start"] + trail - 1, F.get("offset", i))
        return F.struct(
            F.when((trail > 0) | (lead > 0) | (gap > 0), i + 1).otherwise(0).alias("set_at"),
            F.when(trail > 0, from_trail).when((lead > 0) | (gap > 0), from_fill).otherwise(old).alias("value"),
        )

    df = bind(df, marks=F.transform("entries", mark))
    df = bind(df, set_at=F.transform("marks", lambda m: m["set_at"]))
    df = bind(df, set_at=prefix_max("set_at"))
    # The running maximum of (when last set, value) is the largest value since the last set.
    df = bind(
        df,
        marks=F.transform("marks", lambda m, i: F.struct(F.get("set_at", i).alias("at"), m["value"].alias("value"))),
    )
    df = bind(df, marks=prefix_max("marks"))

    def gap_after(x: Column, i: Column) -> Column:
        shown = F.get("marks", i)["value"]
        return F.coalesce((shown > 0) & (x["next_deletion"] > shown + 1), F.lit(False))

    return bind(df, gap_after=F.transform("entries", gap_after)).select("path", "entries", "offset", "gap_after", *keep)


def _same(x: Column) -> Column:
    return F.coalesce(x["old_text"] == x["new_text"], F.lit(False))


_ROW = (
    "struct<line_type:string,old_line:bigint,new_line:bigint,content:string,old_content:string,"
    f"changes:{_CHANGES},old_changes:{_CHANGES},selectable:boolean>"
)


def _row(
    line_type: Column, old: Column, new: Column, content: Column, selectable: bool,
    old_content: Column | None = None, changes: Column | None = None, old_changes: Column | None = None,
) -> Column:
    no_changes = F.array().cast(_CHANGES)
    return F.struct(
        line_type.alias("line_type"),
        old.cast("bigint").alias("old_line"),
        new.cast("bigint").alias("new_line"),
        content.alias("content"),
        (F.lit(None).cast("string") if old_content is None else old_content).alias("old_content"),
        (no_changes if changes is None else changes).alias("changes"),
        (no_changes if old_changes is None else old_changes).alias("old_changes"),
        F.lit(selectable).alias("selectable"),
    ).cast(_ROW)


def file_rows(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, listed, rows): the unified rows of each file as one array in display order.

    Files added, removed or unchanged as a whole are ``listed`` line by line; binary files are left out.
    """
    nothing = F.lit(None).cast("bigint")
    separator = F.array(_row(F.lit("context"), nothing, nothing, F.lit("..."), False))
    none = F.filter(separator, lambda _: F.lit(False))

    def context(part: Column, offset: Column) -> Column:
        return F.transform(
            part["texts"],
            lambda c, k: _row(
                F.lit("context"), context_old_line(part["start"] + k, offset), part["start"] + k, c, True
            ),
        )

    def rows_of(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("offset", i - 1), F.lit(0).cast("bigint"))
        old, new = x["old_line"], x["new_line"]
        pair = old.isNotNull() & new.isNotNull()
        line_type = F.when(pair, "modification").when(old.isNotNull(), "deletion").otherwise("addition")
        own = _row(
            line_type, old, new, F.coalesce(x["new_text"], x["old_text"]), True,
            F.when(pair, x["old_text"]),
            F.when(new.isNull(), x["old_changes"]).otherwise(x["new_changes"]),
            F.when(pair, x["old_changes"]).otherwise(F.array().cast(_CHANGES)),
        )
        return F.concat(
            F.when(x["gap_before"], separator).otherwise(none),
            context(x["lead"], before),
            context(x["gap"], before),
            F.when(_same(x), none).otherwise(F.array(own)),
            context(x["trail"], F.get("offset", i)),
            F.when(F.get("gap_after", i), separator).otherwise(none),
        )

    removed, added = F.col("status") == "removed", F.col("status") == "added"
    listed = (F.coalesce(F.size("chunks"), F.lit(0)) <= 0) & F.col("status").isin("added", "removed", "unchanged")
    lines = text_lines(F.when(removed, F.col("old_content")).otherwise(F.col("new_content")))
    listing = F.when(listed, lines).otherwise(F.array().cast("array<string>"))
    text = bind(files.filter(~F.col("is_binary")), listing=listing)
    kind = F.when(removed, "deletion").when(added, "addition").otherwise("context")

    def listed_row(c: Column, i: Column) -> Column:
        return _row(kind, F.when(~added, i + 1), F.when(~removed, i + 1), c, True)

    whole = F.transform("listing", listed_row)
    rows = with_running_state(text, ["status", "listing", *keep])
    rows = bind(rows, rows=F.concat(F.flatten(F.transform("entries", rows_of)), whole), listed=F.size("listing") > 0)
    return rows.select("path", "listed", "rows", *keep)


def diff_lines(files: DataFrame) -> DataFrame:
    """Unified rows of every file in display order ``ord`` (0-based, gap-free per path).

    Modifications, deletions and additions come with up to three unchanged lines around each
    chunk, gaps inside a chunk filled, and a separator row where unchanged lines are left out.
    Files added, removed or unchanged as a whole list every line. Binary files have no rows.
    """
    return row_table(file_rows(files))


def row_table(df: DataFrame, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The rows of ``file_rows`` one by one, or those that ``keep`` of a row and its place holds for."""
    placed = F.transform("rows", lambda x, i: F.struct(i.cast("bigint").alias("ord"), x.alias("row")))
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["row"], x["ord"].cast("int")))
    rows = df.select("path", "listed", F.explode(placed).alias("x")).select("path", "listed", "x.ord", "x.row.*")
    return _with_spans(rows).select(
        "path", "ord", "line_type", "old_line", "new_line", "content", "old_content", "changes", "old_changes",
        "category", "is_partial_change", "selectable",
    )


def _with_spans(rows: DataFrame) -> DataFrame:
    """Exploded rows with their category and the spans that are shown."""
    changed, pair = F.col("line_type") != "context", F.col("line_type") == "modification"
    # The category follows the recorded spans. Where a pair has none, the computed difference is shown.
    old_recorded = F.when(pair, F.col("old_changes")).when(F.col("line_type") == "deletion", F.col("changes"))
    new_recorded = F.when(F.col("line_type") == "deletion", F.col("old_changes")).otherwise(F.col("changes"))
    kind = category(F.coalesce(old_recorded, F.array().cast(_CHANGES)), new_recorded)
    rows = rows.withColumn("category", F.when(changed & ~F.col("listed"), kind).otherwise("semantic"))
    bare = pair & ((F.size("old_changes") == 0) | (F.size("changes") == 0))
    rows = rows.withColumn("_r", F.when(bare, change_ranges("old_content", "content")))
    rows = rows.withColumn(
        "old_changes",
        F.when(pair, effective_changes(F.col("old_changes"), F.col("_r.old_start"), F.col("_r.old_end"))).otherwise(
            F.col("old_changes")
        ),
    ).withColumn(
        "changes",
        F.when(pair, effective_changes(F.col("changes"), F.col("_r.new_start"), F.col("_r.new_end"))).otherwise(
            F.col("changes")
        ),
    )
    partial = is_partial_change("old_content", "old_changes") | is_partial_change("content", "changes")
    return rows.withColumn("is_partial_change", pair & partial).drop("_r")


_CELL = f"struct<line:bigint,content:string,changes:{_CHANGES},line_type:string,category:string>"


def _cell(line: Column, content: Column, changes: Column, line_type: Column, category: Column) -> Column:
    return F.struct(
        line.alias("line"),
        content.alias("content"),
        changes.alias("changes"),
        line_type.alias("line_type"),
        category.alias("category"),
    ).cast(_CELL)


def split_places(df: DataFrame) -> DataFrame:
    """Replace ``rows`` of ``file_rows`` by ``split``: (ord, row, next, right) of each side-by-side row, in the file's row.

    A deletion directly followed by an addition takes it as ``next``, and the addition has no row
    of its own. ``right`` is the place of the row whose new line stands on the right.
    """

    def joined(x: Column, i: Column) -> Column:
        after = F.get("rows", i + 1)
        pair = (x["line_type"] == "deletion") & F.coalesce(after["line_type"] == "addition", F.lit(False))
        taken = (x["line_type"] == "addition") & F.coalesce(F.get("rows", i - 1)["line_type"] == "deletion", F.lit(False))
        return F.struct(
            i.cast("bigint").alias("ord"), x.alias("row"), F.when(pair, after).alias("next"),
            F.when(pair, i + 1).otherwise(i).alias("right"), taken.alias("taken"),
        )

    return bind(df, split=F.filter(F.transform("rows", joined), lambda x: ~x["taken"]))


def split_table(df: DataFrame) -> DataFrame:
    """The side-by-side rows of ``split_places`` one by one, with the columns of ``split_rows``."""
    rows = df.select("path", "listed", F.explode("split").alias("x"))
    rows = _with_spans(rows.select("path", "listed", "x.ord", "x.next", "x.row.*"))
    kind, after = F.col("line_type"), F.col("next")
    added = category(F.array().cast(_CHANGES), after["changes"])
    after_category = F.when(F.col("listed"), "semantic").otherwise(added)

    left = F.when(
        kind == "context",
        F.when(
            F.coalesce("old_line", F.lit(0)) > 0,
            _cell(F.col("old_line"), F.col("content"), F.col("changes"), kind, F.col("category")),
        ),
    ).when(
        kind == "modification",
        _cell(F.col("old_line"), F.col("old_content"), F.col("old_changes"), F.lit("deletion"), F.col("category")),
    ).when(
        kind == "deletion", _cell(F.col("old_line"), F.col("content"), F.col("changes"), kind, F.col("category"))
    )
    right = F.when(
        kind == "context",
        F.when(
            F.coalesce("new_line", F.lit(0)) > 0,
            _cell(F.col("new_line"), F.col("content"), F.col("changes"), kind, F.col("category")),
        ),
    ).when(
        kind.isin("modification", "addition"),
        _cell(F.col("new_line"), F.col("content"), F.col("changes"), F.lit("addition"), F.col("category")),
    ).when(
        after.isNotNull(),
        _cell(after["new_line"], after["content"], after["changes"], F.lit("addition"), after_category),
    )
    return rows.select(
        "path",
        "ord",
        left.alias("left"),
        right.alias("right"),
        "selectable",
        (left.isNull() & right.isNull()).alias("is_separator"),
    )


def split_rows(files: DataFrame) -> DataFrame:
    """Side-by-side rows of every file.

    A deletion directly followed by an addition shares its row. Context stands on both sides
    where its number is above zero, and a row with neither side is a separator. ``ord`` is the
    unified position of the row's first line: increasing, with a gap where a pair was joined.
    Rows are paired in the file's row: one scan, no shuffle.
    """
    return split_table(split_places(file_rows(files)))


def line_offsets(files: DataFrame, side: str = "new") -> DataFrame:
    """Every line with its number and the byte offset at which it starts."""
    lined = bind(files.select("path", f"{side}_content"), lines=text_lines(f"{side}_content"))
    lined = bind(lined, ends=F.transform("lines", lambda c: (F.octet_length(c) + 1).cast("bigint")))
    lined = bind(lined, ends=prefix_sum("ends"))
    rows = lined.select("path", F.posexplode(F.arrays_zip("lines", "ends")).alias("_p", "x"))
    return rows.select(
        "path",
        (F.col("_p") + 1).cast("bigint").alias("line"),
        F.col("x.lines").alias("content"),
        (F.col("x.ends") - F.octet_length("x.lines") - 1).alias("byte_offset"),
    )
