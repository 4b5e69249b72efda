"""Which rows are on screen, and where the cursor goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators.barrier import bind, prefix_max
from changelens.operators.joins import PART_BYTES, ordered_concat
from changelens.operators.regions import split_with_hidden, with_hidden
from changelens.operators.scan import BLOCK_ROWS, Fold, running

PAGE_ROWS = 20


def flag_rows(df: DataFrame) -> DataFrame:
    """(path, ord, visible, navigable) of the rows of ``file_rows`` with its ``regions``: not folded, and selectable as well."""
    flags = F.transform(
        "rows",
        lambda x, i: F.struct(
            i.cast("bigint").alias("ord"), (~F.get("hidden", i)).alias("visible"), (x["selectable"] & ~F.get("hidden", i)).alias("navigable")
        ),
    )
    return with_hidden(df).select("path", F.inline(flags))


def split_flag_rows(df: DataFrame) -> DataFrame:
    """(path, ord, visible, navigable) of the side-by-side rows of ``file_rows`` with its ``regions``."""

    def flags(x: Column, i: Column) -> Column:
        shown = ~F.get("hidden", i)
        return F.struct(x["ord"].alias("ord"), shown.alias("visible"), (x["row"]["selectable"] & shown).alias("navigable"))

    return split_with_hidden(df).select("path", F.inline(F.transform("split", flags)))


def viewport(rows: DataFrame, path: str, scroll: int, height: int) -> DataFrame:
    """The ``height`` rows of one file that follow the first ``scroll``."""
    return rows.filter(F.col("path") == path).orderBy("ord").offset(scroll).limit(height)


def viewports(df: DataFrame, scroll: int, height: int) -> DataFrame:
    """(path, shown_at, ord): of every file the ``height`` visible rows of ``file_rows`` that follow the first ``scroll``."""
    places = F.transform("rows", lambda _, i: i.cast("bigint"))
    shown = F.slice(F.filter(places, lambda i: ~F.get("hidden", i.cast("int"))), F.lit(scroll + 1), F.lit(height))
    rows = with_hidden(df).select("path", F.posexplode(shown).alias("shown_at", "ord"))
    return rows.select("path", (F.col("shown_at") + scroll).cast("bigint").alias("shown_at"), "ord")


def page_move(cursor: Column, last: Column, down: bool = True, rows: int = PAGE_ROWS) -> Column:
    """Cursor one page on, kept within 0..last."""
    target = cursor + rows if down else cursor - rows
    return F.least(F.greatest(target, F.lit(0)), last)


def scroll_to_line(rows: DataFrame, targets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each (path, line): ``ord`` of the first row whose new line is at or after it, null when none is."""
    asked = targets.select("path", "line").distinct()
    # Scanned from the last line up, so a question comes before the rows of its own line.
    points = (
        rows.filter("new_line is not null")
        .select("path", F.col("new_line").alias("line"), F.lit(1).alias("_tie"), "ord")
        .unionByName(asked.select("path", "line", F.lit(0).alias("_tie"), F.lit(None).cast("bigint").alias("ord")))
    )
    best = running(
        points, ["path"], "line", [Fold("best", F.col("ord"), "min", backward=True)], tie=["_tie"], block_rows=block_rows
    )
    return best.filter("_tie = 0").select("path", "line", F.col("best").alias("ord"))


def nearest_navigable(df: DataFrame) -> DataFrame:
    """(path, ord, cursor): where the cursor goes from each row that a collapse has hidden: up, else down, else to the top."""
    df = bind(with_hidden(df), up=F.transform("rows", lambda x, i: F.when(x["selectable"] & ~F.get("hidden", i), i)))
    # Downwards is upwards in the reversed array, with the places negative.
    df = bind(df, down=F.transform(F.reverse("up"), lambda i: -i))
    df = bind(df, up=prefix_max("up"), down=prefix_max("down"))
    df = bind(df, down=F.reverse("down"))

    def cursor(hidden: Column, i: Column) -> Column:
        at = F.when(hidden, F.coalesce(F.get("up", i), -F.get("down", i), F.lit(0))).otherwise(i)
        return F.struct(i.cast("bigint").alias("ord"), at.cast("bigint").alias("cursor"))

    return df.select("path", F.inline(F.transform("hidden", cursor)))


def rows_in_range(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Unified rows whose new line (old line where there is none) lies in start..end."""
    return rows.filter(F.coalesce("new_line", "old_line").between(start, end))


def excerpt_line(
    line_type: str = "line_type", content: str = "content", old_content: str = "old_content"
) -> Column:
    """A row as text: ``+ - ~`` or a space, then the content; a modification shows old → new."""
    kind = F.col(line_type)
    mark = F.when(kind == "addition", "+").when(kind == "deletion", "-").when(kind == "modification", "~").otherwise(" ")
    before = F.when((kind == "modification") & F.col(old_content).isNotNull(), F.concat(F.col(old_content), F.lit(" → ")))
    return F.concat(mark, F.lit(" "), F.coalesce(before, F.lit("")), F.col(content), F.lit("\n"))


def excerpt(rows: DataFrame, start: Column, end: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, part, code): the selected rows of each file as text, in parts of bounded size."""
    chosen = rows_in_range(rows, start, end)
    return ordered_concat(chosen, ["path"], "ord", excerpt_line(), "code", part_bytes)
