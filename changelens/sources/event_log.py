"""Event logs of a streaming text service: one JSON message per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import json_unescape
from changelens.operators.joins import PART_BYTES
from changelens.operators.scan import whole

PREVIEW_BYTES = 500
# Lines of a log whose first bytes one group holds; a block is one row of the totals.
BLOCK_LINES = 4096


def parse_events(lines: DataFrame) -> DataFrame:
    """Add to (log, pos, line): ``failed``, the ``error`` it names, and the ``delta`` text it carries."""
    line = F.col("line")
    failed = F.contains(line, F.lit('"success":false'))
    error = F.when(
        failed & F.contains(line, F.lit('"error":"')), F.regexp_extract(line, r'"error":"([^"]*)', 1)
    )
    raw = F.regexp_extract(line, r'"delta":"((?:[^"\\]|\\.)*+)', 1)
    delta = F.when(
        F.contains(line, F.lit('"text_delta"')) & F.contains(line, F.lit('"delta":"')), json_unescape(raw)
    )
    return lines.select("log", "pos", "line", failed.alias("failed"), error.alias("error"), delta.alias("delta"))


def responses(
    lines: DataFrame,
    error_prefix: str = "The helper returned an error",
    part_bytes: int = PART_BYTES,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """The answer of each log: (log, outcome, part, text).

    Any failed message makes the log an error with the last message named, whatever text came.
    Otherwise the deltas joined in order, in numbered parts of bounded size. A log without text
    shows the first bytes of its raw lines.

    The lines are read twice: once for the facts of each block of a log, whose totals are carried
    over the blocks, and once for the deltas, which meet the facts of their block.
    """
    events = parse_events(lines).withColumn("block", F.floor(F.col("pos") / block_lines))
    facts = _block_facts(events)
    log, block = Window.partitionBy("log"), Window.partitionBy("log").orderBy("block")
    earlier = block.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(block) == 1
    facts = facts.select(
        "log",
        "block",
        F.max("failed").over(log).alias("failed"),
        F.max_by("error", "error_pos").over(log).alias("error"),
        F.sum("text_bytes").over(log).alias("text_bytes"),
        (F.sum("raw_bytes").over(log) - 1).alias("raw_bytes"),
        F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("raw_bytes").over(earlier), F.lit(0)).alias("raw_before"),
        "opening",
        first.alias("is_first"),
    )
    # A line takes a byte at least, so as many blocks as bytes are enough.
    piece = F.when(F.col("raw_before") < PREVIEW_BYTES, F.struct("block", "opening"))
    facts = facts.withColumn("opening", F.when(F.col("is_first"), _preview(F.collect_list(piece).over(log), "opening")))

    said = events.filter("delta is not null").select("log", "block", "pos", "delta")
    placed = facts.join(said, ["log", "block"], "left")
    inside = Window.partitionBy("log", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The extra byte per piece bounds the number of pieces in a part even when they are empty.
    upto = F.col("before") + F.sum(F.octet_length("delta") + 1).over(inside)
    failed, spoke = F.col("failed"), F.col("text_bytes") > 0
    part = F.when(~failed & spoke & F.col("delta").isNotNull(), whole(upto - 1, part_bytes)).otherwise(0)
    placed = placed.withColumn("part", part.cast("bigint"))
    kept = F.collect_list(F.when(~failed, F.struct("pos", "delta")))
    rows = placed.groupBy("log", "part").agg(
        *[F.first(c).alias(c) for c in ("failed", "error", "text_bytes", "raw_bytes")],
        F.max("opening").alias("opening"),
        F.array_join(F.transform(F.array_sort(kept), lambda x: x["delta"]), "").alias("said"),
    )
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit(error_prefix + ":\n"), F.col("error"))).otherwise(
        error_prefix + " (unknown)"
    )
    preview = F.concat(
        F.format_string("No text response found.\n\nRaw output preview (%d bytes total):\n", "raw_bytes"),
        F.col("opening").cast("string"),
        F.when(F.col("raw_bytes") > PREVIEW_BYTES, "\n...").otherwise(""),
    )
    return rows.select(
        "log",
        F.when(failed, "error").when(spoke, "text").otherwise("empty").alias("outcome"),
        "part",
        F.when(failed, error).when(spoke, F.col("said")).otherwise(preview).alias("text"),
    )


def _block_facts(events: DataFrame) -> DataFrame:
    """What a block of a log's lines adds up to, in one aggregation; ``opening`` are its first bytes."""
    head = F.substring(F.to_binary(F.col("line"), F.lit("utf-8")), 1, PREVIEW_BYTES)
    delta_bytes = F.octet_length("delta")
    return events.groupBy("log", "block").agg(
        F.max("failed").alias("failed"),
        F.max_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
        F.max(F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error_pos"),
        F.coalesce(F.sum(delta_bytes), F.lit(0)).alias("text_bytes"),
        F.coalesce(F.sum(delta_bytes + 1), F.lit(0)).alias("sizes"),
        F.sum(F.octet_length("line") + 1).alias("raw_bytes"),
        _preview(F.collect_list(F.struct("pos", head.alias("head"))), "head").alias("opening"),
    )


def _preview(pieces: Column, field: str) -> Column:
    """The first bytes of pieces joined by line breaks, in their order."""
    newline = F.to_binary(F.lit("\n"), F.lit("utf-8"))
    joined = F.aggregate(
        F.array_sort(pieces),
        F.lit(None).cast("binary"),
        lambda acc, x: F.when(acc.isNull(), x[field])
        .when(F.length(acc) >= PREVIEW_BYTES, acc)
        .otherwise(F.concat(acc, newline, x[field])),
    )
    return F.substring(joined, 1, PREVIEW_BYTES)
