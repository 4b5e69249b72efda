"""Sharding by proportional stratified interleaving: every shard has the mixture of the whole.

Rows are shuffled by a seeded hash within their source and ranked. Sorted by fractional rank,
(rank - 1/2) / rows of the source, any stretch holds every source in proportion; equal cuts of that
order are the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.llm.common import stored

SEED = "shards-1"
# Rows that one task ranks. Hash ranges and fractional ranks are uniform, so blocks are of about this size.
BLOCK_ROWS = 10_000


def _numbered(rows: DataFrame, keys: list[str], block: str, order: list[Column]) -> DataFrame:
    """Add ``_place``: the place from 1 of a row of its ``keys``, ordered by block and then ``order``.

    Rows are numbered inside their block only; blocks are counted with map-side combination, and
    the counts of earlier blocks are carried over them.
    """
    # Dealt out by block as well: an earlier partitioning by the keys alone would put a hot key into one task.
    rows = rows.repartition(*keys, block)
    sizes = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.orderBy(block) if not keys else W.partitionBy(*keys).orderBy(block)
    sizes = sizes.withColumn("_before", F.sum("_n").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy(*keys, block).orderBy(*order)))
    return inside.join(sizes, [*keys, block]).withColumn("_place", F.col("_before") + F.col("_in")).drop("_in", "_n", "_before")


def shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: str = SEED,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of every row; shards' counts differ by one at most.

    Rows without a source form one source; a null text has size 1 and the checksum of an empty
    text; a null id is shuffled as the word null. Equal hashes rank by id, checksum and size, and
    rows equal in these are alike. Repeated rows are all dealt out; an empty table gives no row;
    other columns are ignored.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        docs[source].alias("source"),
        F.concat(F.lit("s"), F.coalesce(docs[source].cast("string"), F.lit("\x00"))).alias("s"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))).cast("binary")).alias("h"),
    )
    rows = stored(rows)
    total = rows.count()
    # Stored, so that its size is known when the join is planned: the rows of a hot source then stay where they are.
    counts = stored(rows.groupBy("s").agg(F.count(F.lit(1)).alias("rows_of_source")))
    part = F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    placed = rows.join(counts, "s").withColumn("block", F.floor(part * F.ceil(F.col("rows_of_source") / block_rows)))
    order = [F.col("h"), F.col("id"), F.col("text_crc32"), F.col("size")]
    ranked = _numbered(placed, ["s"], "block", order)
    fraction = (2 * F.col("_place") - 1) / (2 * F.col("rows_of_source"))
    ranked = stored(ranked.select("id", "source", "s", "size", "text_crc32", fraction.alias("fraction"), F.col("_place").alias("rank")))
    blocks = max(1, -(-total // block_rows))
    dealt = _numbered(ranked.withColumn("block", F.floor(F.col("fraction") * blocks)), [], "block", [F.col("fraction"), F.col("s"), F.col("rank")])
    place = F.col("_place") - 1
    shard = F.expr(f"(_place - 1) * {n_shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    out = dealt.withColumn("shard", shard.cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "text_crc32", "shard", (place - start).alias("slot"))
