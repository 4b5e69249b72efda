"""Unified diffs: numbered hunk lines, and the part of a patch that falls in a line range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import hunk_header, text_lines
from changelens.operators.barrier import bind, prefix_max, prefix_sum


def with_hunk_lines(diffs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Add to (path, diff) the arrays ``lines`` (text and numbers of every line) and ``headers`` (places of ``@@``).

    A diff is one cell, so all counting is done in its row. ``keep`` says whether a hunk line
    lies in the new-line range start..end: additions and context by their new number, deletions
    up to one line further, and a "no newline" marker when something in its hunk was kept.
    """
    df = bind(diffs, text=text_lines("diff"), start=start.cast("bigint"), end=end.cast("bigint"))
    df = bind(df, hunk=F.transform("text", lambda c, i: F.when(c.startswith("@@"), i).otherwise(-1)))
    df = bind(df, hunk=prefix_max("hunk"))

    def kind(c: Column, i: Column) -> Column:
        first, at = F.substring(c, 1, 1), F.get("hunk", i)
        return F.when((at >= 0) & (at != i) & first.isin("+", "-", " ", "\\"), first).otherwise("")

    df = bind(df, kinds=F.transform("text", kind))
    df = bind(
        df,
        old_seen=F.transform("kinds", lambda k: F.when(k.isin("-", " "), 1).otherwise(0).cast("bigint")),
        new_seen=F.transform("kinds", lambda k: F.when(k.isin("+", " "), 1).otherwise(0).cast("bigint")),
    )
    df = bind(df, old_seen=prefix_sum("old_seen"), new_seen=prefix_sum("new_seen"))

    def numbered(k: Column, i: Column) -> Column:
        at = F.get("hunk", i)
        header = hunk_header(F.get("text", at))

        def number(side: str, own: Column) -> Column:
            seen = F.get(f"{side}_seen", i) - F.get(f"{side}_seen", at) - F.when(own, 1).otherwise(0)
            return header[f"{side}_start"] + seen

        return F.struct(
            k.alias("kind"),
            at.alias("hunk"),
            number("old", k.isin("-", " ")).alias("old_no"),
            number("new", k.isin("+", " ")).alias("new_no"),
        )

    df = bind(df, numbered=F.transform("kinds", numbered))

    def in_range(x: Column) -> Column:
        no, first, last = x["new_no"], F.col("start"), F.col("end")
        return (x["kind"].isin("+", " ") & no.between(first, last)) | ((x["kind"] == "-") & no.between(first, last + 1))

    df = bind(df, kept=F.transform("numbered", lambda x: F.coalesce(in_range(x), F.lit(False)).cast("int")))
    df = bind(df, kept_upto=prefix_sum("kept"))

    def line(x: Column, i: Column) -> Column:
        some_before = F.get("kept_upto", i) - F.get("kept_upto", x["hunk"]) > 0
        return F.struct(
            F.get("text", i).alias("text"),
            x["kind"].alias("kind"),
            x["hunk"].alias("hunk"),
            x["old_no"].alias("old_no"),
            x["new_no"].alias("new_no"),
            F.when(x["kind"] == "\\", some_before).otherwise(F.get("kept", i) == 1).alias("keep"),
        )

    df = bind(df, lines=F.transform("numbered", line))
    places = F.sequence(F.lit(0), F.size("text") - 1)
    df = bind(df, headers=F.filter(places, lambda i: F.get("hunk", i) == i))
    return df.select(*diffs.columns, "lines", "headers")


def hunk_lines(diffs: DataFrame, start: Column, end: Column) -> DataFrame:
    """The lines of every hunk with their old and new numbers, hunk by hunk."""
    df = with_hunk_lines(diffs, start, end)
    rows = df.select("path", "headers", F.posexplode("lines").alias("pos", "x")).filter("x.kind <> ''")
    return rows.select(
        "path",
        F.array_position("headers", F.col("x.hunk")).alias("hunk"),
        F.col("pos").cast("bigint").alias("pos"),
        "x.kind", "x.text", "x.old_no", "x.new_no", "x.keep",
    )


def partial_hunks(diffs: DataFrame, start: Column, end: Column) -> DataFrame:
    """(path, preamble, hunks): what remains of each hunk, with recomputed starts and counts."""
    df = with_hunk_lines(diffs, start, end)

    def filtered(h: Column, k: Column) -> Column:
        until = F.coalesce(F.get("headers", k + 1), F.size("lines"))
        inside = F.filter(F.slice("lines", h + 2, until - h - 1), lambda x: x["keep"])
        header = hunk_header(F.get("lines", h)["text"])

        def made(rows: Column) -> Column:
            old = F.filter(rows, lambda x: x["kind"].isin("-", " "))
            new = F.filter(rows, lambda x: x["kind"].isin("+", " "))
            return F.struct(
                (k + 1).cast("bigint").alias("hunk"),
                F.coalesce(F.get(old, F.lit(0))["old_no"], header["old_start"]).alias("old_start"),
                F.size(old).cast("bigint").alias("old_count"),
                F.coalesce(F.get(new, F.lit(0))["new_no"], header["new_start"]).alias("new_start"),
                F.size(new).cast("bigint").alias("new_count"),
                F.array_join(F.transform(rows, lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("body"),
            )

        return F.transform(F.array(inside), made)[0]

    hunks = F.filter(F.transform("headers", filtered), lambda h: h["body"] != "")
    first = F.coalesce(F.get("headers", F.lit(0)), F.size("lines"))
    preamble = F.array_join(
        F.transform(F.slice("lines", F.lit(1), first), lambda x: F.concat(x["text"], F.lit("\n"))), ""
    )
    return df.select("path", preamble.alias("preamble"), hunks.alias("hunks"))


def partial_patch(diffs: DataFrame, start: Column, end: Column) -> DataFrame:
    """(path, patch): the patch reduced to new lines start..end; '' when no line is left."""
    text = F.array_join(
        F.transform(
            "hunks",
            lambda h: F.concat(
                F.format_string(
                    "@@ -%d,%d +%d,%d @@\n", h["old_start"], h["old_count"], h["new_start"], h["new_count"]
                ),
                h["body"],
            ),
        ),
        "",
    )
    df = partial_hunks(diffs, start, end)
    return df.select(
        "path", F.when(F.size("hunks") > 0, F.concat("preamble", text)).otherwise("").alias("patch")
    )
