"""Revision pairs derived from the shared tables, row by row.

Every document becomes one file with an old and a new version. What happens to line ``n`` of
document ``d`` follows from ``h = (31 d + 17 n) mod 20`` where ``n div 20`` is even; the other
runs of 20 lines stay as they are, which leaves gaps wide enough for separators:

====  ==========================================================
h     effect
====  ==========================================================
0     the line is only in the old version
1     new version indents it by two spaces
2     new version appends `` x1`` (no token spans on even lines)
3     ``# `` becomes ``// `` in front of it, marked as comment
4     the line is only in the new version
5     ``the`` becomes ``these`` (equal where the word is absent)
6-19  unchanged
====  ==========================================================

``d mod 12`` of 3, 7 and 9 make the file added, removed and unchanged as a whole. All of it is
computed inside the row, so building the pairs needs no shuffle at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import language_of, mapped, text_lines
from changelens.operators.barrier import bind
from changelens.operators.scan import whole

SUFFIXES = ("rs", "py", "js", "zig", "md")
GAP = 4  # more than this many source lines between two changes starts a new chunk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table read for work inside its rows.

    A scan with fewer splits than the cluster has cores (one small file, say) would leave most of
    them idle, so it is spread out first. A large table has splits enough and stays as read.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def path_of(doc_id: Column) -> Column:
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), F.pmod(doc_id, F.lit(len(SUFFIXES))).cast("int"))
    return F.concat(F.lit("src/"), doc_id.cast("string"), F.lit("."), suffix)


def _side(number: Column, content: Column, h: Column, src: Column) -> Column:
    token = F.struct(
        F.lit(0).alias("start"),
        F.octet_length(content).cast("int").alias("end"),
        content.alias("content"),
        F.when(h == 3, "comment").otherwise("novel").alias("highlight"),
    )
    bare = (h == 2) & (src % 2 == 0)
    return F.struct(
        number.cast("int").alias("line_number"),
        F.filter(F.array(token), lambda _: ~bare).alias("changes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed files: path, language, status, is_binary, old_content, new_content, chunks."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    fate = F.pmod("doc_id", F.lit(12))
    status = F.when(fate == 3, "added").when(fate == 7, "removed").when(fate == 9, "unchanged").otherwise("changed")
    docs = docs.withColumn("status", status)

    def tag(c: Column, i: Column) -> Column:
        n = i.cast("bigint") + 1
        quiet = F.pmod(whole(n, 20), F.lit(2)) == 1
        h = F.when(quiet, F.lit(19).cast("bigint")).otherwise(F.pmod(F.col("doc_id") * 31 + n * 17, F.lit(20)))
        return F.struct(n.alias("n"), c.alias("c"), h.alias("h"))

    docs = bind(docs, tagged=F.transform(text_lines("text"), tag))

    def old_line(x: Column, i: Column) -> Column:
        text = F.when(x["h"] == 3, F.concat(F.lit("# "), x["c"])).otherwise(x["c"])
        return F.struct(x["n"].alias("n"), x["h"].alias("h"), i.alias("i"), text.alias("c"))

    def new_line(x: Column, i: Column) -> Column:
        h, c = x["h"], x["c"]
        text = (
            F.when(h == 1, F.concat(F.lit("  "), c))
            .when(h == 2, F.concat(c, F.lit(" x1")))
            .when(h == 3, F.concat(F.lit("// "), c))
            .when(h == 5, F.replace(c, F.lit("the"), F.lit("these")))
            .otherwise(c)
        )
        return F.struct(x["n"].alias("n"), h.alias("h"), i.alias("i"), text.alias("c"))

    docs = bind(
        docs,
        old=F.transform(F.filter("tagged", lambda x: x["h"] != 4), old_line),
        new=F.transform(F.filter("tagged", lambda x: x["h"] != 0), new_line),
        # h is a permutation of 0..19 over 20 lines, so each kind occurs once in every 40 lines and
        # the number of one-sided lines before line n follows from where the first one is.
        first_deleted=_first_line_with(0),
        first_added=_first_line_with(4),
    )

    def entry(x: Column) -> Column:
        h, n = x["h"], x["n"]
        lhs_no = n - 1 - _seen_before(n, F.col("first_added"))
        rhs_no = n - 1 - _seen_before(n, F.col("first_deleted"))
        lhs = F.when(h != 4, _side(lhs_no, F.get("old", lhs_no.cast("int"))["c"], h, n))
        rhs = F.when(h != 0, _side(rhs_no, F.get("new", rhs_no.cast("int"))["c"], h, n))
        return F.struct(n.alias("n"), lhs.alias("lhs"), rhs.alias("rhs"))

    docs = bind(docs, entries=F.transform(F.filter("tagged", lambda x: x["h"] <= 5), entry))
    places = F.when(F.size("entries") > 0, F.sequence(F.lit(0), F.size("entries") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    docs = bind(
        docs,
        starts=F.filter(
            places,
            lambda i: (i == 0) | (F.get("entries", i)["n"] - F.get("entries", i - 1)["n"] > GAP),
        ),
    )

    def chunk(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("entries"))
        return F.transform(
            F.slice("entries", start + 1, end - start),
            lambda e: F.struct(e["lhs"].alias("lhs"), e["rhs"].alias("rhs")),
        )

    def joined(lines: str) -> Column:
        return F.array_join(F.transform(lines, lambda x: x["c"]), "\n")

    changed = F.col("status") == "changed"
    path = path_of(F.col("doc_id"))
    return docs.select(
        path.alias("path"),
        language_of(path).alias("language"),
        "status",
        F.lit(False).alias("is_binary"),
        F.when(changed, joined("old")).when(F.col("status") == "added", "").otherwise(F.col("text")).alias("old_content"),
        F.when(changed, joined("new")).when(F.col("status") == "removed", "").otherwise(F.col("text")).alias("new_content"),
        F.when(changed, F.transform("starts", chunk))
        .otherwise(F.array().cast(schemas.CHUNKS))
        .cast(schemas.CHUNKS)
        .alias("chunks"),
    )


def _first_line_with(kind: int) -> Column:
    """First n >= 1 outside the quiet runs with (31 d + 17 n) mod 20 = kind (13 inverts 17 modulo 20)."""
    n = F.pmod((F.lit(kind) - F.col("doc_id") * 31) * 13, F.lit(20))
    return F.when(n == 0, F.lit(40)).otherwise(n).cast("bigint")


def _seen_before(n: Column, first: Column) -> Column:
    """How many of first, first + 40, first + 80, … lie below n."""
    return F.when(n > first, whole(n - first - 1, 40) + 1).otherwise(F.lit(0)).cast("bigint")


def diff_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as one JSON record per file, in the shape an external diff tool writes."""
    shown = files(spark, sf_dir).withColumn(
        "status", mapped("status", {"added": "created", "removed": "deleted"}, F.col("status"))
    )
    return shown.select(F.to_json(F.struct("path", "language", "status", "chunks")).alias("record"))


# Fixed shapes of the regions laid over the lines: five-line blocks.
REGION_KINDS = ("function", "struct_", "enum_", "union_", "test_decl", "class")


def with_line_regions(pairs: DataFrame) -> DataFrame:
    """Add ``regions``: five-line blocks of every version that has a text, as stand-in constructs (see schemas.REGIONS).

    Odd-numbered files (by length of the path) repeat three names, so duplicate names occur.
    """
    repeated = F.pmod(F.length("path"), F.lit(2)) == 1

    def block(side: str, n_lines: Column, ix: Column) -> Column:
        kind = F.get(F.array(*[F.lit(k) for k in REGION_KINDS]), F.pmod(ix, F.lit(len(REGION_KINDS))).cast("int"))
        start = ix * 5 + 1
        return F.struct(
            F.lit(side).alias("side"),
            start.alias("start_line"),
            F.least(start + 4, n_lines).alias("end_line"),
            start.alias("header_end_line"),
            kind.alias("node_type"),
            F.concat(F.lit("r"), F.when(repeated, F.pmod(ix, F.lit(3))).otherwise(ix).cast("string")).alias("name"),
            (F.pmod(F.length("path") + ix, F.lit(2)) == 0).alias("collapsed"),
            (F.lit(1) + F.pmod(ix, F.lit(3))).cast("bigint").alias("level"),
        )

    def blocks(side: str) -> Column:
        count = F.col(f"{side}_lines")
        every = F.transform(F.sequence(F.lit(0).cast("bigint"), whole(count - 1, 5)), lambda ix: block(side, count, ix))
        return F.when(F.col(f"{side}_content") != "", every)

    counts = {f"{side}_lines": F.size(text_lines(f"{side}_content")).cast("bigint") for side in ("old", "new")}
    counted = bind(pairs, **counts)
    return bind(counted, regions=F.flatten(F.array_compact(F.array(blocks("old"), blocks("new"))))).drop(*counts)


def line_regions(pairs: DataFrame) -> DataFrame:
    return with_line_regions(pairs).select("path", F.inline("regions"))


def session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Comments and staged ranges read off the conversations: conversation = file, turn = line."""
    turns = table(spark, sf_dir, "conversations")
    path = path_of(F.col("conv_id"))
    comments = turns.select(
        path.alias("path"),
        F.when(F.col("role") == "user", "new").otherwise("old").alias("side"),
        (F.col("turn") + 1).alias("line_start"),
        (F.col("turn") + 1 + F.pmod("turn", F.lit(2))).alias("line_end"),
        "text",
    )
    staged = turns.select(
        path.alias("path"),
        F.when(F.col("role") == "user", "new").otherwise("old").alias("side"),
        (F.col("turn") * 4 + 1).alias("line_start"),
        (F.col("turn") * 4 + 1 + F.pmod(F.length("text"), F.lit(7))).cast("bigint").alias("line_end"),
    )
    return comments, staged
