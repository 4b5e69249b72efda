"""The summary of a file inside its row: constructs matched by name, their changed lines, and the counters.

Does what ``constructs.file_summary`` does for tables of regions and lines, for files that carry
their regions and chunks as cells. Sorting and running values along arrays take the place of
joins, so a file is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import language_of
from changelens.operators.barrier import bind, prefix_max, prefix_sum
from changelens.operators.constructs import COUNTERS
from changelens.operators.entries import CosmeticConfig, category
from changelens.operators.scan import numbered

# Items whose places meet in one bucket.
ITEM_BUCKET = 64
_CHANGES = f"array<{schemas.CHANGE}>"


def with_changed_lines(df: DataFrame, config: CosmeticConfig = CosmeticConfig()) -> DataFrame:
    """Add ``changed``: (line, category) of each file's distinct changed new lines in order, with the category written last."""
    none = F.array().cast(_CHANGES)

    def entry(e: Column, i: Column) -> Column:
        old, new = F.coalesce(e["lhs"]["changes"], none), F.coalesce(e["rhs"]["changes"], none)
        return F.struct((e["rhs"]["line_number"] + 1).cast("bigint").alias("line"), i.alias("at"), category(old, new, config=config).alias("category"))

    flat = F.coalesce(F.flatten("chunks"), F.array().cast(f"array<{schemas.ENTRY}>"))
    df = bind(df, _entries=flat)
    df = bind(df, _lines=F.sort_array(F.filter(F.transform("_entries", entry), lambda x: x["line"].isNotNull())))
    last = F.filter("_lines", lambda x, i: F.coalesce(F.get("_lines", i + 1)["line"] != x["line"], F.lit(True)))
    return bind(df, changed=F.transform(last, lambda x: F.struct(x["line"].alias("line"), x["category"].alias("category")))).drop("_entries", "_lines")


def _after(values: str) -> Column:
    """The least place at or after each one of the (bound) array ``values`` of places and nulls, negated."""
    return F.reverse(prefix_max(values))


def with_matches(df: DataFrame) -> DataFrame:
    """Add ``matched``: constructs in both versions (modified candidates), only in the new (added), only in the old (deleted).

    Sorted by name with the old version first, a new region finds the last old one of its name
    behind it, and an old region finds the first new one of its name ahead.
    """

    def keyed(r: Column) -> Column:
        return F.struct(
            r["name"].alias("name"), F.when(r["side"] == "new", 1).otherwise(0).alias("new"), r["start_line"].alias("start"),
            r["level"].alias("level"), r["end_line"].alias("end"), r["node_type"].alias("node_type"),
        )

    top = F.filter("regions", lambda r: (r["level"] == 1) & (r["name"] != ""))
    df = bind(df, _top=F.sort_array(F.transform(top, keyed)))
    df = bind(
        df,
        _old=F.transform("_top", lambda r, i: F.when(r["new"] == 0, i).otherwise(-1)),
        _new=F.reverse(F.transform("_top", lambda r, i: F.when(r["new"] == 1, -i))),
    )
    df = bind(df, _old=prefix_max("_old"), _new=_after("_new"))

    def match(r: Column, i: Column) -> Column:
        before, ahead = F.get("_top", F.get("_old", i)), F.get("_top", -F.get("_new", i))
        known = F.when(before["name"] == r["name"], before["end"] - before["start"])
        change = F.when(r["new"] == 0, "deleted").when(known.isNull(), "added").otherwise("modified")
        return F.struct(
            r["name"].alias("name"), r["node_type"].alias("node_type"), change.alias("change_type"), r["start"].alias("line_start"),
            r["end"].alias("line_end"), F.when(r["new"] == 1, known).alias("old_size"),
            ((r["new"] == 1) | ~F.coalesce(ahead["name"] == r["name"], F.lit(False))).alias("stays"),
        )

    return bind(df, matched=F.filter(F.transform("_top", match), lambda c: c["stays"])).drop("_top", "_old", "_new")


def match_constructs(df: DataFrame) -> DataFrame:
    """The constructs of ``with_matches`` one by one."""
    return with_matches(df).select("path", F.inline("matched")).drop("stays")


def with_constructs(df: DataFrame) -> DataFrame:
    """Add ``constructs``: those of ``regions`` that were added, deleted or modified, as in ``constructs.changed_constructs``.

    The ends of the constructs and the changed lines, sorted by line, carry how many lines and how
    many semantic ones came before, and which cosmetic line comes next.
    """
    df = with_changed_lines(with_matches(df))

    def event(at: Column, tie: int, i: Column, n: int, kind: Column) -> Column:
        semantic = F.when(kind == "semantic", n).otherwise(0)
        return F.struct(
            at.alias("at"), F.lit(tie).alias("tie"), i.cast("int").alias("i"), F.lit(n).cast("bigint").alias("n"),
            semantic.cast("bigint").alias("semantic"), kind.alias("category"),
        )

    no_kind = F.lit(None).cast("string")
    ends = F.transform(
        "matched", lambda c, i: F.array(event(c["line_start"], 0, i, 0, no_kind), event(c["line_end"], 2, i, 0, no_kind))
    )
    lines = F.transform("changed", lambda x, i: event(x["line"], 1, i, 1, x["category"]))
    df = bind(df, _events=F.sort_array(F.concat(F.flatten(ends), lines)))
    df = bind(
        df,
        _n=F.transform("_events", lambda e: e["n"]),
        _semantic=F.transform("_events", lambda e: e["semantic"]),
        _next=F.reverse(F.transform("_events", lambda e, i: F.when((e["n"] == 1) & (e["semantic"] == 0), -i))),
    )
    df = bind(df, _n=prefix_sum("_n"), _semantic=prefix_sum("_semantic"), _next=_after("_next"))

    def seen(e: Column, i: Column) -> Column:
        ahead = F.get("_events", -F.get("_next", i))
        return F.struct(
            e["i"].alias("i"), e["tie"].alias("tie"), F.get("_n", i).alias("n"), F.get("_semantic", i).alias("semantic"),
            ahead["at"].alias("line"), ahead["category"].alias("category"),
        )

    # Two entries for each construct, in their order: at its first line and after its last.
    df = bind(df, _seen=F.sort_array(F.filter(F.transform("_events", seen), lambda x: x["tie"] != 1)))

    def construct(c: Column, i: Column) -> Column:
        first, last = F.get("_seen", 2 * i), F.get("_seen", 2 * i + 1)
        changes, size = last["n"] - first["n"], c["line_end"] - c["line_start"]
        modified, resized = c["change_type"] == "modified", size != c["old_size"]
        cosmetic = F.when(first["line"] <= c["line_end"], first["category"])
        kind = (
            F.when(~modified | (last["semantic"] > first["semantic"]), "semantic")
            .when(resized, "whitespace")
            .otherwise(F.coalesce(cosmetic, F.lit("semantic")))
        )
        return F.when(
            ~modified | (changes > 0) | resized,
            F.struct(
                *[c[k].alias(k) for k in ("name", "node_type", "change_type", "line_start", "line_end")],
                F.when(modified, changes).otherwise(size + 1).alias("lines_changed"), kind.alias("category"),
            ),
        )

    made = F.array_compact(F.transform("matched", construct))
    return bind(df, constructs=made).drop("_events", "_n", "_semantic", "_next", "_seen", "matched", "changed")


def changed_constructs(df: DataFrame) -> DataFrame:
    """The constructs of ``with_constructs`` one by one."""
    return with_constructs(df).select("path", F.inline("constructs"))


def file_summary(df: DataFrame) -> DataFrame:
    """One row of counters per file that carries ``regions`` and ``chunks``; without a language only its lines count."""
    known = F.when(language_of("path").isNotNull(), F.col("constructs"))
    df = bind(with_constructs(df), constructs=F.coalesce(known, F.filter("constructs", lambda _: F.lit(False))))
    df = bind(df.select("path", "chunks", "constructs"), _entries=F.coalesce(F.flatten("chunks"), F.array().cast(f"array<{schemas.ENTRY}>")))
    of = lambda bucket: [k for k, b in schemas.STAT_BUCKETS.items() if b == bucket]

    def count(array: str, condition) -> Column:
        return F.size(F.filter(array, condition)).cast("bigint")

    def of_kind(bucket: str, change: str):
        return lambda c: c["node_type"].isin(of(bucket)) & (c["change_type"] == change)

    counts = {f"{b}_{t}": count("constructs", of_kind(b, t)) for b in schemas.BUCKETS for t in schemas.CHANGE_TYPES}
    counts["lines_added"] = count("_entries", lambda e: e["lhs"].isNull() & e["rhs"].isNotNull())
    counts["lines_deleted"] = count("_entries", lambda e: e["lhs"].isNotNull() & e["rhs"].isNull())
    counts["lines_modified"] = count("_entries", lambda e: e["lhs"].isNotNull() & e["rhs"].isNotNull())
    counts["cosmetic_changes"] = count("constructs", lambda c: c["category"] != "semantic")
    counts["semantic_changes"] = count("constructs", lambda c: c["category"] == "semantic")
    return df.select("path", *[counts[c].alias(c) for c in COUNTERS])


def with_items(df: DataFrame, show_cosmetic: bool = False) -> DataFrame:
    """Add ``items``: the constructs that the overview lists, in its order: by first line, change and name."""

    def placed(c: Column) -> Column:
        return F.struct(c["line_start"].alias("line_start"), c["change_type"].alias("change_type"), c["name"].alias("name"), c.alias("construct"))

    listed = F.filter("constructs", lambda c: F.lit(show_cosmetic) | (c["category"] == "semantic"))
    ordered = F.transform(F.sort_array(F.transform(listed, placed)), lambda x: x["construct"])
    return bind(with_constructs(df), items=ordered)


def items_at(df: DataFrame, places: DataFrame) -> DataFrame:
    """(place, path, nth, construct): the k-th item of the whole overview, files by path, for each ``place`` from 0.

    Each range of paths counts its items; the counts before it are carried over, so only the ranges'
    counts meet, and a file's items stay in its row. Places beyond the last item give no row.
    """
    sized = df.select("path", "items", F.size("items").cast("bigint").alias("n")).filter("n > 0")
    first = numbered(sized, ["path"], "upto", weight="n").withColumn("before", F.col("upto") - F.col("n"))
    hit = places.select(F.col("place").cast("bigint").alias("place"))
    # A question meets the file that holds its place through the buckets that the file's items cover.
    spread = first.select(
        "path", "items", "before",
        F.explode(F.sequence(F.floor(F.col("before") / ITEM_BUCKET), F.floor((F.col("before") + F.size("items") - 1) / ITEM_BUCKET))).alias("bucket"),
    )
    asked = hit.withColumn("bucket", F.floor(F.col("place") / ITEM_BUCKET))
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.size("items"))
    nth = (F.col("place") - F.col("before")).cast("int")
    return spread.join(asked, "bucket").filter(inside).select("place", "path", nth.cast("bigint").alias("nth"), F.get("items", nth).alias("construct"))
