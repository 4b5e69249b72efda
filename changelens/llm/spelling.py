"""Spelling variants: words whose letter multisets share a PartEnum signature are compared, near ones grouped.

A word is a binary vector: one dimension for each letter and how often it has occurred so far. One
replaced letter changes two dimensions, an inserted or deleted one changes one. The dimensions are
dealt into parts; two words that differ in k of them agree on all parts but k, so they share one of
the signatures made by leaving out each choice of k parts. Signatures meet by an equi-join, and the
pairs found are verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices, stored

# Parts that the dimensions are dealt into, for pairs of equal length (two differences) and of lengths one apart (one).
PARTS = 4
# A signature that more words have than this is divided by the letters around the stretch of the word that an edit is in.
BUCKET = 16
STRETCHES = 3
LEAST_LENGTH = 5
LEAST_COUNT = 3
# Every so many runs of a document, by hash, lose a letter; None: none does.
SLIPS = 97
# A form is this many times as frequent as its variant.
FACTOR = 2
# Words that a task counts before it passes the counts on.
COUNTED_WORDS = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xD6E8FEB86659FD93)


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", slips: int | None = SLIPS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the runs of Latin letters of all texts, lower-cased in A-Z, of ``least_length`` or more; n is over all rows."""
    run_of = re.compile(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}")
    source = docs.select(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.lit(":")).alias("id"), docs[text].alias("text"))

    def passed(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at, part in slices(batch.column("text")):
                for id_, body in zip(ids[at : at + len(part)], part):
                    # Lower-casing bytes changes A-Z only.
                    found = Counter(run_of.findall(body.encode().lower().decode()))
                    if slips:
                        seed = zlib.crc32(id_.encode())
                        for word in [w for w in found if zlib.crc32(w.encode(), seed) % slips == 0]:
                            k = zlib.crc32(word.encode(), seed) % len(word)
                            less, n = word[:k] + word[k + 1 :], found.pop(word)
                            if len(less) >= least_length:
                                total[less] += n
                    total.update(found)
                if len(total) > COUNTED_WORDS:
                    yield passed(total)
                    total = Counter()
        yield passed(total)

    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MORE
    x = (x ^ (x >> np.uint64(32))) * _MORE
    return x ^ (x >> np.uint64(32))


def _hashed(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the letters from ``starts`` to ``ends``, by running sums of each letter mixed with its place from ``starts``."""
    size = ends - starts
    own = np.repeat(starts, size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    terms = _mixed(letters[own + place].astype(np.uint64) * _MIX + place.astype(np.uint64) * _MORE)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    stop = np.cumsum(size)
    return _mixed(upto[stop] - upto[stop - size])


def _tagged(value: np.ndarray, *tags: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        for tag in tags:
            value = _mixed(value * _MIX + (tag.astype(np.uint64) if isinstance(tag, np.ndarray) else np.uint64(tag)))
    return value


def _stretches(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """For each of ``STRETCHES`` stretches of a word of length ``base``, a hash of the letters before and after it.

    The word itself has ``base`` letters or one more. Two words one edit apart agree around the
    stretch of the edit: before it counted from the start, after it counted from the end.
    """
    cut = [base * k // STRETCHES for k in range(STRETCHES + 1)]
    before = [_hashed(letters, starts, starts + c) for c in cut[:-1]]
    after = [_hashed(letters, ends - (base - c), ends) for c in cut[1:]]
    return [_tagged(x, y, k) for k, (x, y) in enumerate(zip(before, after))]


def signatures(words: list[str], parts: int = PARTS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word's place, signature, hashes around each stretch) of all signatures of the words.

    Signatures of pairs of equal length leave out two parts, those of pairs of lengths one apart
    leave out one; the latter are given once with the word as the shorter and once as the longer one.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    starts = ends - size
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        # How often a letter has occurred in its word so far.
        order = np.lexsort((letters, owner))
        same = np.concatenate(([False], (letters[order][1:] == letters[order][:-1]) & (owner[order][1:] == owner[order][:-1])))
        place = np.arange(len(order))
        nth = place - np.maximum.accumulate(np.where(same, 0, place))
        dims = _mixed((letters[order].astype(np.uint64) << np.uint64(16)) + nth.astype(np.uint64) + np.uint64(1))
        part = (dims >> np.uint64(40)) % np.uint64(parts)
        value = np.stack([np.add.reduceat(np.where(part == k, dims, np.uint64(0)), starts) for k in range(parts)])
        total = value.sum(axis=0, dtype=np.uint64)
        equal, longer = _stretches(letters, starts, ends, size), _stretches(letters, starts, ends, size - 1)
        made = []
        for i in range(parts):
            less = total - value[i]
            made.append((_tagged(less, size, 1, i), *equal))
            made.append((_tagged(less, size - 1, 1, i), *longer))
            made += [(_tagged(less - value[j], size, 2, i * parts + j), *equal) for j in range(i + 1, parts)]
    sign, *around = [np.concatenate(x).view(np.int64) for x in zip(*made)]
    return np.tile(np.arange(len(words)), len(made)), sign, around


def near_pairs(words: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, n_a, b, n_b), a < b, of words (word, n) that differ by one inserted, deleted or replaced code point.

    A signature of more than ``bucket`` words also needs equal letters around one of the stretches of
    the word; every pair has one such stretch, so nothing is lost.
    """
    names = [f"around{k}" for k in range(STRETCHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                own = batch.column("word").slice(at, 2000)
                who, sign, around = signatures(own.to_pylist(), parts)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(who)), pa.array(sign), *map(pa.array, around)], ["word", "sign", *names])

    fields = "word string, sign bigint, " + ", ".join(f"{n} bigint" for n in names)
    signed = stored(words.select("word").mapInArrow(run, fields))
    shared = stored(signed.groupBy("sign").agg(F.count(F.lit(1)).alias("words")).filter("words > 1"))
    split = F.transform(F.array(*names), lambda x: F.xxhash64("sign", x))
    keys = F.when(F.col("words") <= bucket, F.array("sign")).otherwise(split)
    keyed = signed.join(shared, "sign").select("word", F.explode(keys).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = a.join(b, near).select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()
    counted = lambda side: words.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    return pairs.join(counted("a"), "a").join(counted("b"), "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: each step doubles how far a word looks along the forms.

    A form is at least ``FACTOR`` times as frequent as its word, so there is no circle, and the number
    of steps is at most the logarithm of the logarithm of the largest count.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        a, b = reached.alias("a"), reached.alias("b")
        further = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        further = stored(further.select(F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        reached = further.drop("moved")
        if further.filter("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    slips: int | None = SLIPS,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``least_count`` times or more.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is
    ``factor`` times as frequent, else null; ``root`` follows forms to the last. A null or empty text
    has no words; a null id counts as the word null in the draw of slips; repeated rows count each
    time; an empty table gives an empty result; other columns are ignored.
    """
    words = stored(word_counts(docs, text, id_col, slips, least_length).filter(F.col("n") >= least_count))
    pairs = stored(near_pairs(words))
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best")
    judged = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.m") >= F.col("n") * factor
    judged = stored(judged.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    last = roots(judged.filter("form is not null"))
    named = judged.join(last, "word", "left")
    out = words.join(named, "word", "left")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
