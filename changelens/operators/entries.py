"""Diff entries as rows, their classification, and the counts that need nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import (
    column,
    equal_ignoring_whitespace,
    is_blank,
    text_lines,
    whitespace_change_type,
)
from changelens.operators.barrier import bind, prefix_max


@dataclass(frozen=True)
class CosmeticConfig:
    """Which cosmetic classes to detect, and from which body similarity on a construct counts as moved."""

    comments: bool = True
    whitespace: bool = True
    min_confidence: float = 0.80
    move_similarity: float = 0.90

    @classmethod
    def strict(cls) -> "CosmeticConfig":
        return cls(min_confidence=0.95, move_similarity=0.99)


CONTEXT_LINES = 3
_CHANGES = f"array<{schemas.CHANGE}>"


def diff_entries(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per entry, with the text of the lines it points to, and columns of the file to ``keep``.

    Numbering, the order within a chunk and the line lookup happen inside the file's row, so
    this needs no shuffle. ``pos`` counts entries in display order over the whole file:
    chunk by chunk, each sorted by new line (old line where there is none), ties as recorded.
    """
    rows = with_entry_array(files, context=False, keep=keep).select("path", *keep, F.posexplode("entries").alias("pos", "x"))
    return rows.select(
        "path",
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        "x.chunk_idx",
        "x.entry_idx",
        "x.entry_rank",
        "x.old_line",
        "x.new_line",
        "x.old_changes",
        "x.new_changes",
        "x.old_text",
        "x.new_text",
    )


def plain_entries(files: DataFrame) -> DataFrame:
    """One row per entry as recorded, without line texts: contents are not read, nothing is sorted."""
    chunks = files.select("path", F.posexplode("chunks").alias("c", "chunk"))
    rows = chunks.select("path", "c", F.posexplode("chunk").alias("i", "e"))
    return rows.select(
        "path",
        F.col("c").cast("bigint").alias("chunk_idx"),
        F.col("i").cast("bigint").alias("entry_idx"),
        (F.col("e.lhs.line_number") + 1).cast("bigint").alias("old_line"),
        (F.col("e.rhs.line_number") + 1).cast("bigint").alias("new_line"),
        F.coalesce("e.lhs.changes", F.array().cast(_CHANGES)).alias("old_changes"),
        F.coalesce("e.rhs.changes", F.array().cast(_CHANGES)).alias("new_changes"),
    )


def with_entry_array(files: DataFrame, context: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(path, entries): the entries of each file in display order, with what the views need around them.

    Files without chunks are left out, unless columns to ``keep`` are named.

    With ``context`` each entry carries the unchanged new lines that may be shown next to it and were not shown by
    an earlier chunk: ``lead`` before a chunk's first entry, ``gap`` since the chunk's previous
    new-side entry, ``trail`` after the chunk's last entry, each with the number of its first line.
    """
    chunks = F.coalesce("chunks", F.array().cast(schemas.CHUNKS))
    given = files.select("path", "old_content", "new_content", chunks.alias("chunks"), *keep)
    lined = bind(
        given if keep else given.filter(F.size("chunks") > 0),
        old_lines=text_lines("old_content"),
        new_lines=text_lines("new_content"),
    )
    if not context:
        ranked = F.transform("chunks", lambda c, i: _ranked_chunk(c, i, context=False))
        return lined.select("path", F.flatten(ranked).alias("entries"), *keep)
    lined = bind(lined, bounds=F.transform("chunks", _bounds))
    lined = bind(lined, reach=F.transform("bounds", lambda b: F.coalesce(b["reach"], F.lit(0).cast("bigint"))))
    lined = bind(lined, reach=prefix_max("reach"))
    return lined.select("path", F.flatten(F.transform("chunks", lambda c, i: _ranked_chunk(c, i))).alias("entries"), *keep)


def _bounds(chunk: Column) -> Column:
    """First and last lines of a chunk (1-based, null without that side) and the last line its context reaches."""
    old = F.transform(chunk, lambda e: (e["lhs"]["line_number"] + 1).cast("bigint"))
    new = F.transform(chunk, lambda e: (e["rhs"]["line_number"] + 1).cast("bigint"))
    last = F.array_max(new)
    reach = F.greatest(F.least(last + CONTEXT_LINES, F.size("new_lines").cast("bigint")), last)
    return F.struct(
        F.array_min(old).alias("first_old"),
        F.array_min(new).alias("first_new"),
        last.alias("last_new"),
        F.when(last.isNotNull(), F.greatest(F.array_min(new) - CONTEXT_LINES, F.lit(1).cast("bigint"))).alias("start"),
        F.when(last.isNotNull(), reach).alias("reach"),
        F.size(chunk).cast("bigint").alias("entries"),
    )


def _ranked_chunk(chunk: Column, chunk_idx: Column, context: bool = True) -> Column:
    """A chunk's entries in display order, with line texts and surrounding unchanged lines."""
    keyed = F.transform(
        chunk,
        lambda e, i: F.struct(
            F.coalesce(e["rhs"]["line_number"], e["lhs"]["line_number"], F.lit(0)).alias("key"),
            i.alias("i"),
            e.alias("e"),
        ),
    )

    def texts(x: Column, rank: Column) -> list[Column]:
        lhs, rhs = x["e"]["lhs"], x["e"]["rhs"]
        old_text = F.when(lhs.isNotNull(), F.coalesce(F.get("old_lines", lhs["line_number"]), F.lit("")))
        new_text = F.when(rhs.isNotNull(), F.coalesce(F.get("new_lines", rhs["line_number"]), F.lit("")))
        return [
            chunk_idx.cast("bigint").alias("chunk_idx"),
            x["i"].cast("bigint").alias("entry_idx"),
            (rank + 1).cast("bigint").alias("entry_rank"),
            (lhs["line_number"] + 1).cast("bigint").alias("old_line"),
            (rhs["line_number"] + 1).cast("bigint").alias("new_line"),
            F.coalesce(lhs["changes"], F.array().cast(_CHANGES)).alias("old_changes"),
            F.coalesce(rhs["changes"], F.array().cast(_CHANGES)).alias("new_changes"),
            old_text.alias("old_text"),
            new_text.alias("new_text"),
        ]

    if not context:
        return F.transform(F.array_sort(keyed), lambda x, rank: F.struct(*texts(x, rank)))

    bounds = F.get("bounds", chunk_idx)
    # Last new line that earlier chunks have shown, their trailing context included.
    shown = F.coalesce(F.get("reach", chunk_idx - 1), F.lit(0).cast("bigint"))
    # New-side entries know the new-side entry before them; the chunk's first one has no gap.
    on_new = F.array_sort(F.filter(keyed, lambda x: x["e"]["rhs"].isNotNull()))
    with_gap = F.transform(
        F.array(on_new),
        lambda r: F.transform(
            r,
            lambda x, i: F.struct(
                x["key"].alias("key"),
                x["i"].alias("i"),
                x["e"].alias("e"),
                F.when(i > 0, F.get(r, i - 1)["e"]["rhs"]["line_number"] + 2).cast("bigint").alias("gap_from"),
            ),
        ),
    )[0]
    on_old = F.transform(
        F.filter(keyed, lambda x: x["e"]["rhs"].isNull()),
        lambda x: F.struct(
            x["key"].alias("key"), x["i"].alias("i"), x["e"].alias("e"), F.lit(None).cast("bigint").alias("gap_from")
        ),
    )

    def unchanged(first: Column, last: Column) -> Column:
        """New lines first..last that were not shown before: struct(start, texts), '' beyond the text."""
        start = F.when(first.isNotNull(), F.greatest(first, shown + 1))
        count = F.coalesce(F.greatest(last - start + 1, F.lit(0)), F.lit(0)).cast("int")
        have = F.slice("new_lines", F.coalesce(start, F.lit(1)).cast("int"), count)
        return F.struct(
            start.alias("start"),
            F.concat(have, F.array_repeat(F.lit(""), count - F.size(have))).alias("texts"),
        )

    def shown_entry(x: Column, rank: Column) -> Column:
        rhs = x["e"]["rhs"]
        first, last = rank == 0, rank + 1 == bounds["entries"]
        none = F.lit(None).cast("bigint")
        return F.struct(
            *texts(x, rank),
            F.coalesce(first & (shown > 0) & (bounds["start"] > shown + 1), F.lit(False)).alias("gap_before"),
            unchanged(F.when(first, bounds["start"]).otherwise(none), bounds["first_new"] - 1).alias("lead"),
            unchanged(x["gap_from"], rhs["line_number"]).alias("gap"),
            unchanged(F.when(last, bounds["last_new"] + 1).otherwise(none), bounds["reach"]).alias("trail"),
            # Where a next chunk starts that only deletes.
            F.when(
                last & F.get("bounds", chunk_idx + 1)["first_new"].isNull(),
                F.greatest(F.get("bounds", chunk_idx + 1)["first_old"] - CONTEXT_LINES, F.lit(1)),
            ).alias("next_deletion"),
        )

    return F.transform(F.array_sort(F.concat(with_gap, on_old)), shown_entry)


# --- predicates on token spans -------------------------------------------------------------------


def is_novel(highlight: Column | str) -> Column:
    return column(highlight) != "normal"


def is_semantic_highlight(highlight: Column | str) -> Column:
    return column(highlight).isin(*schemas.SEMANTIC_HIGHLIGHTS)


def all_comments(changes: Column | str) -> Column:
    """Every span is a comment and there is at least one."""
    changes = column(changes)
    return (F.size(changes) > 0) & F.forall(changes, lambda c: c["highlight"] == "comment")


def comment_only(old_changes: Column | str, new_changes: Column | str) -> Column:
    return all_comments(F.concat(column(old_changes), column(new_changes)))


def first_content(changes: Column | str) -> Column:
    """Content of a side's first span, '' without one. The whitespace rules look at this span alone."""
    return F.coalesce(F.get(column(changes), F.lit(0))["content"], F.lit(""))


def whitespace_only(old_changes: Column | str, new_changes: Column | str) -> Column:
    old, new = first_content(old_changes), first_content(new_changes)
    return ((old != "") | (new != "")) & equal_ignoring_whitespace(old, new)


def is_cosmetic(category: Column | str) -> Column:
    return column(category) != "semantic"


def category(
    old_changes: Column | str = "old_changes",
    new_changes: Column | str = "new_changes",
    config: CosmeticConfig = CosmeticConfig(),
) -> Column:
    """comment, whitespace or semantic, the first that applies; the config can switch the first two off."""
    comment = comment_only(old_changes, new_changes) if config.comments else F.lit(False)
    whitespace = whitespace_only(old_changes, new_changes) if config.whitespace else F.lit(False)
    return F.when(comment, "comment").when(whitespace, "whitespace").otherwise("semantic")


def comment_analysis(old_changes: Column | str, new_changes: Column | str) -> Column:
    """struct(category, confidence, details) of the comment rule alone."""
    old, new = column(old_changes), column(new_changes)
    has_old, has_new = F.size(old) > 0, F.size(new) > 0
    details = (
        F.when(has_old & ~has_new & all_comments(old), "comment removed")
        .when(~has_old & has_new & all_comments(new), "comment added")
        .when(all_comments(old) & all_comments(new), "comment modified")
    )
    return _analysis("comment", details)


def whitespace_analysis(old_changes: Column | str, new_changes: Column | str) -> Column:
    """struct(category, confidence, details) of the whitespace rule alone."""
    old, new = column(old_changes), column(new_changes)
    has_old, has_new = F.size(old) > 0, F.size(new) > 0
    before, after = first_content(old), first_content(new)
    details = (
        F.when(has_new & ~has_old & is_blank(after), "blank line added")
        .when(has_old & ~has_new & is_blank(before), "blank line removed")
        .when(has_old & has_new & equal_ignoring_whitespace(before, after), whitespace_change_type(before, after))
    )
    return _analysis("whitespace", details)


def _analysis(kind: str, details: Column) -> Column:
    return F.struct(
        F.when(details.isNotNull(), kind).otherwise("semantic").alias("category"),
        F.lit(1.0).alias("confidence"),
        details.alias("details"),
    )


def classify(entries: DataFrame, config: CosmeticConfig = CosmeticConfig()) -> DataFrame:
    """Add ``category`` and ``same`` (a pair whose full lines are equal, which the views skip)."""
    same = F.coalesce(F.col("old_text") == F.col("new_text"), F.lit(False))
    return entries.select("*", category(config=config).alias("category"), same.alias("same"))


# --- counts -----------------------------------------------------------------------------------------


def line_counts(entries: DataFrame) -> DataFrame:
    """Added, deleted and modified lines per file. Every entry counts, pairs of equal lines too."""
    old, new = F.col("old_line").isNotNull(), F.col("new_line").isNotNull()
    return entries.groupBy("path").agg(
        F.count_if(new & ~old).alias("lines_added"),
        F.count_if(old & ~new).alias("lines_deleted"),
        F.count_if(old & new).alias("lines_modified"),
    )


def file_line_counts(files: DataFrame) -> DataFrame:
    """The counts of ``line_counts`` for every file, taken from the file's row."""
    none = F.array().cast(f"array<{schemas.ENTRY}>")
    flat = bind(files.select("path", "chunks"), entries=F.coalesce(F.flatten("chunks"), none))

    def count(condition: str) -> Column:
        return F.expr(f"cast(size(filter(entries, e -> {condition})) as bigint)")

    return flat.select(
        "path",
        count("e.lhs is null and e.rhs is not null").alias("lines_added"),
        count("e.lhs is not null and e.rhs is null").alias("lines_deleted"),
        count("e.lhs is not null and e.rhs is not null").alias("lines_modified"),
    )


def cosmetic_counts(classified: DataFrame) -> DataFrame:
    """Changed lines per cosmetic class and file, among those a view shows."""
    shown = classified.filter(~F.col("same"))
    each = [F.count_if(F.col("category") == c).alias(f"{c}_changes") for c in schemas.COSMETIC]
    return shown.groupBy("path").agg(*each, F.count_if(is_cosmetic("category")).alias("total"))


def chunk_bounds(entries: DataFrame) -> DataFrame:
    """First and last old and new line of every chunk; a side without lines is null."""
    return entries.groupBy("path", "chunk_idx").agg(
        F.min("old_line").alias("first_old"),
        F.max("old_line").alias("last_old"),
        F.min("new_line").alias("first_new"),
        F.max("new_line").alias("last_new"),
        F.count(F.lit(1)).alias("entries"),
    )


def changed_lines(entries: DataFrame, config: CosmeticConfig = CosmeticConfig()) -> DataFrame:
    """Distinct changed new lines with the category written last."""
    if "category" not in entries.columns:
        entries = entries.withColumn("category", category(config=config))
    return (
        entries.filter(F.col("new_line").isNotNull())
        .groupBy("path", F.col("new_line").alias("line"))
        .agg(F.max_by("category", F.struct("chunk_idx", "entry_idx")).alias("category"))
    )
