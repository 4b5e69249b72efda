"""Substring dedup by hashing lines: the earliest occurrence of a unit stays, later ones go with their offsets.

A unit is a line, cut further after the end of a sentence, so that a passage set into the middle
of a line is found as well. Consecutive repeated units of a document form a run; a run is removed
only if it has enough words, so that a stock phrase in a clean document stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.llm.common import slices, stored

# From a visible character to the end of the line, or of a sentence that a blank follows.
UNIT = re.compile(r"\S[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*[.!?]*")
# Words of a run of consecutive repeated units from which on it is removed; with 1 every repeated unit goes.
RUN_WORDS = 1


def units_of(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, words, h1, h2) of each unit; offsets in code points, a 128-bit hash in two halves."""
    out = []
    for m in UNIT.finditer(text):
        words = m.group().lower().split()
        h = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
        out.append((m.start(), m.end(), len(words), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
    return out


def units(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per unit of every row: id, digest (of the text), unit number, start, end, words, h1, h2."""
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"), docs[text].alias("text"))
    kind = dict(source.dtypes)["id"]
    names = ["start", "end", "words", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), 1 << 20):
                made = [units_of(t) for t in part]
                sizes = np.array([len(m) for m in made], np.int64)
                row = np.repeat(np.arange(first, first + len(part)), sizes)
                number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat = np.array([u for m in made for u in m], np.int64).reshape(-1, 5)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("digest").take(at), pa.array(number), *map(pa.array, np.ascontiguousarray(flat.T))],
                    ["id", "digest", "unit", *names],
                )

    return source.mapInArrow(run, f"id {kind}, digest bigint, unit bigint, " + ", ".join(f"{n} bigint" for n in names))


def removals(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per removed unit: id, digest, start, end, words, and where its first occurrence is.

    Occurrences rank by (id, digest, start); a null id ranks first. A null or empty text has no
    unit. Rows that repeat an id and its text are one document: they do not remove each other's
    units. An empty table gives an empty result; other columns are ignored.

    The units are made twice from the texts instead of being written: the first pass only counts
    hashes, and the second keeps units whose hash occurs again.
    """
    made = units(docs, text, id_col)
    again = stored(made.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    repeated = stored(made.join(again, "h1", "left_semi"))
    rank = F.struct("id", "digest", "start")
    # Stored, so that the join below is of two plain inputs and a hot unit's rows can be split.
    first = stored(repeated.groupBy("h1", "h2").agg(F.min(rank).alias("first")))
    later = repeated.join(first, ["h1", "h2"]).filter(~rank.eqNullSafe(F.col("first")))
    later = later.select("id", "digest", "unit", "start", "end", "words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")).distinct()
    of_doc = W.partitionBy("id", "digest")
    if run_words <= 1:
        return later.select(F.col("id").alias(id_col), "digest", "start", "end", "words", "first_id", "first_start")
    runs = later.withColumn("run", F.col("unit") - F.row_number().over(of_doc.orderBy("unit")))
    summed = runs.withColumn("run_words", F.sum("words").over(W.partitionBy("id", "digest", "run")))
    return summed.filter(F.col("run_words") >= run_words).select(F.col("id").alias(id_col), "digest", "start", "end", "words", "first_id", "first_start")


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without its removed units, and ``removed``: their (start, end) in the old text.

    A document without removals keeps its text as it is and has an empty ``removed``.
    """
    gone = removals(docs, text, id_col, run_words)
    spans = stored(gone.groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")))
    same = docs[id_col].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == spans["_digest"])
    joined = docs.drop("removed").join(spans, same, "left").drop("_id", "_digest")
    none = F.array().cast(joined.schema["removed"].dataType)
    joined = joined.withColumn("removed", F.coalesce("removed", none))
    cut = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["kept"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).alias("kept"),
            x["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    return joined.withColumn(text, F.when(F.size("removed") > 0, cut).otherwise(F.col(text)))
