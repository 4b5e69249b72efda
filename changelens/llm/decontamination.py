"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. The n-grams of the test items are counted over all documents.
2. The n-grams that documents hold are seeds, but for as many of an item's commonest as no copy can do with alone.
3. Documents are scanned for seeds; a seed places its item at one diagonal of the document.
4. The passage around each diagonal is aligned with the item, word by word; the best score counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from changelens.llm.common import gram_filter, passes, slices, stored, without, word_grams

MATCH, MISMATCH, GAP = 2, -1, -1
# Of the score of a whole, unchanged item.
THRESHOLD = 0.6
ALIGNED_ROWS = 256


def seed_plan(n_words: int, threshold: float) -> tuple[int, int]:
    """(width, shared): a passage that reaches ``threshold`` of an item has ``shared`` of its places of ``width`` words at least.

    With M equal words and E edits the score is 2 M - E, and the equal words stand in at most E + 1 runs, so at
    least M - E - 1 of the item's pairs of words are whole: not under (2 threshold - 1) n - 1. Where that may be
    none, single words are taken; at least threshold n of them are equal.
    """
    pairs = (2 * threshold - 1) * n_words - 1
    if pairs > 1e-9:
        return 2, math.ceil(pairs - 1e-9)
    return 1, max(1, math.ceil(threshold * n_words - 1e-9))


def item_grams(items: DataFrame, text: str, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(item, place, gram, width, shared) of the items' n-grams by ``seed_plan``; an item without a word has none."""
    source = items.select(items[id_col].alias("item"), items[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                plans = [seed_plan(len(t.encode().split()), threshold) for t in part]
                grams = [word_grams(t, width)[0] for t, (width, _) in zip(part, plans)]
                sizes = [len(g) for g in grams]
                row = np.repeat(np.arange(first, first + len(part)), sizes)
                place = [np.arange(n) for n in sizes]
                plan = np.repeat(np.array(plans, np.int64), sizes, axis=0)
                made = [pa.array(np.concatenate(place)), pa.array(np.concatenate(grams)), pa.array(plan[:, 0]), pa.array(plan[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), *made], ["item", "place", "gram", "width", "shared"])

    return source.mapInArrow(run, f"item {dict(source.dtypes)['item']}, place bigint, gram bigint, width bigint, shared bigint")


def found_grams(text: str, widths: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the n-grams of a text that pass the filter, for all ``widths``."""
    made = [word_grams(text, width)[0] for width in widths]
    at = [np.flatnonzero(passes(bits, g)) for g in made]
    return np.concatenate(at), np.concatenate([g[k] for g, k in zip(made, at)])


def gram_counts(docs: DataFrame, text: str, widths: list[int], bits: np.ndarray) -> DataFrame:
    """(gram, n) over all documents for n-grams in the filter; summed per batch before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column("text")):
                found = [found_grams(t, widths, shared.value)[1] for t in part]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def rare_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, place, gram): the n-grams of an item that some document holds, without its ``shared`` - 1 commonest places.

    A passage that reaches the threshold has ``shared`` of the places, so one of the others at least.
    """
    ranked = grams.join(counts, "gram").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("n"), "place")))
    return ranked.filter(F.col("rank") >= F.col("shared")).select("item", "place", "gram").distinct()


def seeded_documents(docs: DataFrame, text: str, id_col: str, widths: list[int], bits: np.ndarray) -> DataFrame:
    """(id, digest, text, hits) of the documents with an n-gram in the filter; hits are (place, gram)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"), docs[text].alias("text"))
    hits = pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                rows, found = [], []
                for k, t in enumerate(part):
                    places, grams = found_grams(t, widths, shared.value)
                    if len(places):
                        rows.append(first + k)
                        found.append([{"place": p, "gram": g} for p, g in zip(places.tolist(), grams.tolist())])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "digest", "text")), pa.array(found, hits)], ["id", "digest", "text", "hits"])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, digest bigint, text string, hits array<struct<place bigint, gram bigint>>")


def align(items: list[list[bytes]], passages: list[list[bytes]]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs at once along the anti-diagonals.

    Cells of one anti-diagonal depend on the two before it only; pairs are padded to the longest
    with words that match nothing.
    """
    ids: dict[bytes, int] = {}
    n, m, k = max(map(len, items)), max(map(len, passages)), len(items)
    x, y = np.full((k, n), -1, np.int32), np.full((k, m), -2, np.int32)
    for rows, grid in ((items, x), (passages, y)):
        for r, words in enumerate(rows):
            grid[r, : len(words)] = [ids.setdefault(w, len(ids)) for w in words]
    # Cell (i, j) of diagonal d = i + j is kept at i; index 0 is the empty prefix.
    before, last = np.zeros((k, n + 1), np.int32), np.zeros((k, n + 1), np.int32)
    best = np.zeros(k, np.int32)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        same = x[:, lo - 1 : hi] == y[:, d - hi - 1 : d - lo][:, ::-1]
        score = before[:, lo - 1 : hi] + np.where(same, MATCH, MISMATCH)
        score = np.maximum(score, np.maximum(last[:, lo - 1 : hi], last[:, lo : hi + 1]) + GAP)
        now = np.zeros_like(last)
        now[:, lo : hi + 1] = np.maximum(score, 0)
        best = np.maximum(best, now.max(axis=1))
        before, last = last, now
    return best


def scored(candidates: DataFrame, id_kind: str, item_kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """Best score of each (id, digest, item): candidates are (id, digest, text, spots) with spots (item, item_text, block)."""
    schema = f"id {id_kind}, digest bigint, item {item_kind}, score double, word_start bigint, word_end bigint"
    spot = candidates.schema["spots"].dataType.elementType
    id_type, item_type = to_arrow_type(candidates.schema["id"].dataType), to_arrow_type(spot["item"].dataType)

    def aligned(pending: list[tuple]) -> pa.RecordBatch:
        points = align([p[3] for p in pending], [p[4] for p in pending])
        score = points / (MATCH * np.array([len(p[3]) for p in pending]))
        columns = [[p[c] for p in pending] for c in (0, 1, 2)]
        made = [pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], item_type), pa.array(score)]
        bounds = [pa.array([p[5] for p in pending], pa.int64()), pa.array([p[5] + len(p[4]) for p in pending], pa.int64())]
        return pa.RecordBatch.from_arrays([*made, *bounds], ["id", "digest", "item", "score", "word_start", "word_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("id", "digest", "text", "spots")}
                words = row["text"].as_py().encode().lower().split()
                for spot in row["spots"].as_py():
                    item = spot["item_text"].encode().lower().split()
                    # Diagonals are grouped by the half of an item; a passage covers its whole group, and on
                    # either side as many words more as can be inserted into a copy that reaches the threshold.
                    half = max(1, len(item) // 2)
                    slack = max(half, math.ceil(2 * (1 - threshold) * len(item)))
                    start = max(0, spot["block"] * half - slack)
                    passage = words[start : (spot["block"] + 1) * half + slack + len(item)]
                    # So many words of the item must be equal for the score; most chance hits have fewer.
                    inside = set(passage)
                    if sum(w in inside for w in item) < threshold * len(item) - 1e-9:
                        continue
                    pending.append((row["id"].as_py(), row["digest"].as_py(), spot["item"], item, passage, start))
                    if len(pending) == ALIGNED_ROWS:
                        yield aligned(sorted(pending, key=lambda p: len(p[4])))
                        pending = []
        if pending:
            yield aligned(pending)

    return candidates.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and item whose alignment reaches ``threshold``: id, digest, item, score, word bounds.

    Words are what the six ASCII blanks separate, with A-Z lowered. The score is that of the best
    local alignment over that of the whole item. A null text or one without a word
    holds no seed, and neither does such an item. Rows that repeat an id and its text give one row
    per item; an empty table on either side gives an empty result; other columns are ignored.
    """
    items = items.select(items[item_id].alias("item"), items[item_text].alias("text")).filter(F.col("text").isNotNull())
    grams = stored(item_grams(items, "text", "item", threshold))
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect()) or [2]
    counts = gram_counts(docs, text, widths, gram_filter(grams)).join(grams.select("gram").distinct(), "gram", "left_semi")
    seeds = stored(rare_seeds(grams, counts))
    # The texts of documents with seeds are kept; the join below drops what only the filter let pass.
    found = stored(seeded_documents(docs, text, id_col, widths, gram_filter(seeds)))
    hits = found.select("id", "digest", F.explode(F.array_distinct("hits")).alias("hit")).select("id", "digest", "hit.place", "hit.gram")
    placed = seeds.join(items, "item").select("item", "gram", F.col("place").alias("item_place"), F.col("text").alias("item_text"))
    n_words = F.size(F.split(F.trim(F.regexp_replace("item_text", r"[\x20\x09-\x0D]+", " ")), " "))
    half = F.greatest(F.lit(1), F.floor(n_words / 2))
    spots = hits.join(placed, "gram").select("id", "digest", "item", "item_text", F.floor((F.col("place") - F.col("item_place")) / half).alias("block"))
    spots = spots.distinct().groupBy("id", "digest").agg(F.collect_list(F.struct("item", "item_text", "block")).alias("spots"))
    f, s = found.alias("f"), spots.alias("s")
    candidates = f.join(s, F.col("f.id").eqNullSafe(F.col("s.id")) & (F.col("f.digest") == F.col("s.digest"))).select("f.id", "f.digest", "f.text", "s.spots")
    kinds = dict(candidates.dtypes)
    rows = scored(candidates, kinds["id"], dict(items.dtypes)["item"], threshold).filter(F.col("score") >= threshold)
    best = rows.groupBy("id", "digest", "item").agg(F.max(F.struct("score", "word_start", "word_end")).alias("b"))
    return best.select(F.col("id").alias(id_col), "digest", F.col("item").alias(item_id), "b.score", "b.word_start", "b.word_end")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    bad = contaminated(docs, items, text, id_col, **options)
    bad = stored(bad.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).distinct())
    return without(docs, bad, text, id_col)
