"""Structural diff records in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import column, mapped
from changelens.operators.barrier import bind, prefix_sum

# A string literal, a brace, or a run of anything else.
_PIECE = r'"(?:[^"\\]|\\[\s\S])*+"|[{}]|[^"{}]++|"'


def split_objects(df: DataFrame, text: str) -> DataFrame:
    """One row per top-level JSON object of a text in which objects follow each other freely.

    Pieces are cut so that braces inside strings do not count; an object ends where the running
    brace depth returns to zero. An object that never ends is dropped.
    """
    rest = [c for c in df.columns if c != text]
    cut = bind(df, pieces=F.regexp_extract_all(F.col(text), F.lit(_PIECE), F.lit(0)))
    step = F.transform("pieces", lambda p: F.when(p == "{", 1).when(p == "}", -1).otherwise(0))
    cut = bind(cut, depth=step)
    cut = bind(cut, depth=prefix_sum("depth"))
    places = F.when(F.size("pieces") > 0, F.sequence(F.lit(0), F.size("pieces") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    ends = F.filter(places, lambda i: (F.get("depth", i) == 0) & (F.get("pieces", i) == "}"))
    cut = bind(cut, ends=ends)

    def piece(end: Column, k: Column) -> Column:
        start = F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
        return F.trim(F.array_join(F.slice("pieces", start + 1, end - start + 1), ""), F.lit(" \t\r\n"))

    return cut.select(*rest, F.explode(F.transform("ends", piece)).alias("record"))


def _side(side: Column) -> Column:
    def change(c: Column) -> Column:
        known = mapped(c["highlight"], schemas.HIGHLIGHTS, F.lit("novel"))
        return F.struct(
            F.coalesce(c["start"], F.lit(0)).alias("start"),
            F.coalesce(c["end"], F.lit(0)).alias("end"),
            F.coalesce(c["content"], F.lit("")).alias("content"),
            F.when(c["highlight"].isNull(), "normal").otherwise(known).alias("highlight"),
        )

    spans = F.coalesce(F.transform(side["changes"], change), F.array().cast(f"array<{schemas.CHANGE}>"))
    return F.when(
        side.isNotNull(),
        F.struct(F.coalesce(side["line_number"], F.lit(0)).alias("line_number"), spans.alias("changes")),
    )


def parse_records(records: DataFrame, text: str = "record") -> DataFrame:
    """Diff records as rows (path, language, status, chunks), next to the other columns.

    Text that is no JSON object is skipped. Missing fields take their defaults: path "unknown",
    language "Text", status changed, no chunks, line 0, highlight normal; an unknown highlight
    is novel.
    """
    rest = [c for c in records.columns if c != text]
    schema = schemas.DIFF_RECORD[:-1] + ",_bad:string>"
    parsed = records.withColumn("_r", F.from_json(text, schema, {"columnNameOfCorruptRecord": "_bad"}))
    parsed = parsed.filter(F.col("_r._bad").isNull() & F.ltrim(F.col(text)).startswith("{"))
    chunks = F.transform(
        F.col("_r.chunks"),
        lambda chunk: F.transform(
            chunk, lambda e: F.struct(_side(e["lhs"]).alias("lhs"), _side(e["rhs"]).alias("rhs"))
        ),
    )
    return parsed.select(
        *rest,
        F.coalesce("_r.path", F.lit("unknown")).alias("path"),
        F.coalesce("_r.language", F.lit("Text")).alias("language"),
        status_of("_r.status").alias("status"),
        F.coalesce(chunks, F.array().cast(schemas.CHUNKS)).alias("chunks"),
    )


def status_of(word: Column | str) -> Column:
    """Status of a record's status word; an absent or unknown word is "changed"."""
    return F.coalesce(mapped(column(word), schemas.RECORD_STATUS), F.lit("changed"))


def with_real_path(records: DataFrame, real_path: Column) -> DataFrame:
    """Replace the path a diff tool reports (a temporary file, say) by the real one."""
    return records.withColumn("path", real_path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from files of one JSON object per line."""
    return parse_records(spark.read.text(path).withColumnRenamed("value", "record"))
