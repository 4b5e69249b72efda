"""Helpers shared by the operators: tables, stored intermediates, bindings and word hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words, everywhere in this package.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on one machine, where it is unset, one beside the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/_checkpoints")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends, and a lost executor costs nothing."""
    path = os.path.join(shared_folder(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, although the body mentions it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; no text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null as empty) of about ``size`` bytes, each with the place of its first text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield start, [t or "" for t in texts.slice(start, i + 1 - start).to_pylist()]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, [t or "" for t in texts.slice(start).to_pylist()]


# Bits of the filters of hashes sent to all tasks; 2 MB whatever the number of hashes, as an exact join follows.
FILTER_BITS = 24
FILTER_SHIFTS = (0, 20, 40)


def filter_places(gram: Column) -> list[Column]:
    """The bits that stand for a hash in the filter: three parts of it."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    return [F.shiftrightunsigned(gram, shift).bitwiseAND(mask) for shift in FILTER_SHIFTS]


def gram_filter(grams: DataFrame) -> np.ndarray:
    """Three bits of each hash in a table of fixed size, combined by Spark; at most 2^18 words come back."""
    places = grams.select(F.explode(F.array(*filter_places(F.col("gram")))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in rows.toLocalIterator():
        bits[row["at"]] = np.uint64(row["bits"] & (2**64 - 1))
    return bits


def passes(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; a false one is dropped by the join that follows."""
    ok = np.ones(len(grams), bool)
    for shift in FILTER_SHIFTS:
        place = (grams.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        ok &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return ok


def without(docs: DataFrame, keys: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and digest are not in ``keys`` (_id, _digest), with all their columns.

    A row whose hash is not in the filter of the keys stays without a join. Only the others, those that
    go and few more, meet the keys, so no other text is shuffled however many keys there are.
    """
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    bits = docs.sparkSession.sparkContext.broadcast(gram_filter(keys.select(F.xxhash64("_id", "_digest").alias("gram"))))

    @F.arrow_udf("boolean")
    def met(hashes: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, hashes.to_numpy(zero_copy_only=False)))

    told = docs.select("*", met(F.xxhash64(docs[id_col], digest)).alias("_met"))
    some = told.filter("_met")
    same = some[id_col].eqNullSafe(keys["_id"]) & (F.xxhash64(F.coalesce(some[text], F.lit(""))) == keys["_digest"])
    return told.filter("not _met").union(some.join(keys, same, "left_anti")).drop("_met")


# Rolling hash of word sequences, modulo 2^64.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n`` words in a row, lower-cased in A-Z, with the byte bounds of the words.

    Works on the bytes of the text at once: no object per word. Returns (gram hashes as int64,
    word starts, word ends); a text with fewer than ``n`` words has no gram.
    """
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < n:
        return np.empty(0, np.int64), starts, ends
    with np.errstate(over="ignore"):
        # A word's value is the sum of its bytes, each mixed with its place in the word.
        place = np.arange(len(raw), dtype=np.int64)
        inside = place - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
        if inside is None:
            first = np.concatenate(([0], starts))
            inside = place - np.repeat(first, np.diff(np.append(first, len(raw))))
        terms = _mixed((raw.astype(np.uint64) + np.uint64(1)) * _STEP + inside.astype(np.uint64) * _MIX)
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        value = _mixed(upto[ends] - upto[starts])
        gram = value[: len(value) - n + 1].copy()
        for k in range(1, n):
            gram = _mixed(gram * _STEP + value[k : len(value) - n + 1 + k])
    return gram.view(np.int64), starts, ends
