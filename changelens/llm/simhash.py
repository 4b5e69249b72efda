"""SimHash near-duplicates: fingerprints, pigeonring candidates, links and components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices, stored, without, word_grams

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 4
# A bucket with more fingerprints than this is cut further instead of paired.
BUCKET = 64

# Near-duplicate groups: texts whose word fingerprints differ in at most NEAR bits, and whose sketches of five-word
# shingles, of 128 bits, differ in at most NEAR_SKETCH. At a Jaccard similarity of 0.8 the sketches differ in
# 19 bits with a standard error of 4, at 0.5 in 34, and at 0 in 64.
NEAR = 6
NEAR_SHINGLE = 5
NEAR_SKETCH = 28
# A bucket with more nodes than this is cut further instead of paired.
NEAR_BUCKET = 1000
# Rounds in which each bucket of these pairs of parts links one node to its near duplicates, before pairs of different groups
# are checked in all buckets. Pairs of one round are disjoint: nodes with three different bits or fewer meet in one at least.
NEAR_STARS = (((0, 1), (2, 3), (4, 5), (6, 7)), ((0, 4), (1, 5), (2, 6), (3, 7)))
# Links that a label is carried along after each of these rounds; members of one star are two links apart.
NEAR_STEPS = 4
# Free bits and parts of each cut: no more than NEAR parts can differ, so two at least are equal.
NEAR_CUTS = ((64, 8), (48, 8), (36, 9))

# A byte's bits as eight byte-wide counters: bit k of the byte is byte k of the word.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles; no word gives zero."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only the six ASCII blanks split
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(words) - SHINGLE + 1)
    return int(majority(hashes)) & 0xFFFFFFFFFFFFFFFF


def majority(hashes: np.ndarray) -> np.int64:
    """The 64 bits that are set in over half of the hashes, as a signed number."""
    # Counters of eight bits hold 255 hashes; blocks of them are then summed at full width.
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    blocks = np.add.reduceat(spread, np.arange(0, len(hashes), 255), axis=0)
    counts = blocks.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]


def fingerprints(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, digest, fp) of every row; fp as a signed long, digest a hash of the text."""
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    source = docs.select(docs[id_col].alias("id"), digest.alias("digest"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t) for _, part in slices(batch.column("text")) for t in part]
            prints = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), prints], ["id", "digest", "fp"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, digest bigint, fp bigint")


def segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def chain_holds(diff: Column, first: int, width: int, distance: int = DISTANCE, parts: int = SEGMENTS) -> Column:
    """Whether some segment of the ring starts a chain that keeps within its proportional budgets.

    If at most ``distance`` bits differ, there is a start from which, for every length l, the next l
    segments together differ in at most l * distance / parts bits.
    """
    size = width // parts
    counts = [F.bit_count(segment(diff, first + k * size, size)) for k in range(parts)]
    found = F.lit(False)
    for start in range(parts):
        total, holds = F.lit(0), F.lit(True)
        for length in range(1, parts + 1):
            total = total + counts[(start + length - 1) % parts]
            holds = holds & (total <= length * distance // parts)
        found = found | holds
    return found


def bucket_keys(prints: DataFrame, first: int, width: int) -> DataFrame:
    """One row per fingerprint and pair of segments of the ``width`` free bits from ``first``.

    A chain starts with an equal segment, and of the two after it at most one bit differs in all,
    so one of these is equal too: every link shares two of the four segments.
    """
    size = width // SEGMENTS
    keys = [
        F.struct(
            F.lit(a * SEGMENTS + b).alias("pair"),
            segment(F.col("fp"), first + a * size, size).alias("x"),
            segment(F.col("fp"), first + b * size, size).alias("y"),
        )
        for a in range(SEGMENTS)
        for b in range(a + 1, SEGMENTS)
    ]
    return prints.select("*", F.explode(F.array(*keys)).alias("k"))


def _permuted(fp: Column, pair: int, width: int) -> Column:
    """The lowest ``width`` bits with the two segments of ``pair`` last, so that the free ones are the low half."""
    size = width // SEGMENTS
    a, b = divmod(pair, SEGMENTS)
    order = [k for k in range(SEGMENTS) if k not in (a, b)] + [a, b]
    out = F.lit(0).cast("bigint")
    for place, k in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(segment(fp, k * size, size), place * size))
    if width < 64:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, width), width))
    return out


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints ``fp`` at ``DISTANCE`` or fewer differing bits.

    Fingerprints meet in buckets of two equal segments of four. A bucket with more than ``bucket`` of
    them has its free bits (32, then 16) cut into four segments again, and its members meet only
    where two of those are equal as well; after the third cut 8 bits are free, so no bucket holds
    more than 256. Nothing is dropped, and no task pairs a large group. ``q`` is the fingerprint
    with its bits reordered: distances are the same, the free bits are always the lowest.
    """
    found = None
    level = prints.select("fp", F.col("fp").alias("q"), F.lit("").alias("at"))
    for width in (64, 32, 16):
        keyed = bucket_keys(level.withColumn("real", F.col("fp")).withColumn("fp", F.col("q")), 0, width)
        keyed = keyed.select(F.col("real").alias("fp"), "q", F.concat_ws("/", "at", "k.pair", "k.x", "k.y").alias("at"), F.col("k.pair").alias("pair"))
        sizes = keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        known = stored(keyed.join(sizes, "at"))
        last = width == 16
        small = known if last else known.filter(F.col("n") <= bucket)
        a, b = small.alias("a"), small.alias("b")
        diff = F.col("a.q").bitwiseXOR(F.col("b.q"))
        near = (F.col("a.at") == F.col("b.at")) & (F.col("a.fp") < F.col("b.fp")) & chain_holds(diff, 0, width) & (F.bit_count(diff) <= DISTANCE)
        pairs = a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        moved = F.lit(None).cast("bigint")
        for x in range(SEGMENTS):
            for y in range(x + 1, SEGMENTS):
                moved = F.when(F.col("pair") == x * SEGMENTS + y, _permuted(F.col("q"), x * SEGMENTS + y, width)).otherwise(moved)
        level = known.filter(F.col("n") > bucket).select("fp", moved.alias("q"), "at")
    return found.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked one reaches.

    Alternates the large-star and small-star steps until no link changes; each step groups with
    map-side minima only, and each round's links are stored in the shared folder.
    """
    edges = stored(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    state = None
    while True:
        # Large star: every neighbour above u moves to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: the lower neighbours of v, and v, move to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v")
        small = moved.select(F.col("m").alias("u"), "v").union(moved.filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        edges = stored(small)
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(total) == state:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        state = tuple(total)


def members(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, fp, component) of every row; component is the smallest id that the row reaches."""
    prints = stored(fingerprints(docs, text, id_col))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp")))
    # A fingerprint of one row without a link needs no join: its component is that row.
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce(F.col("root"), F.col("fp")))
    ids = named.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("rows")).filter(F.col("rows") > 1).drop("rows")
    known = stored(named.join(ids, "root").select("fp", "component"))
    return prints.join(known, "fp", "left").select("id", "digest", "fp", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    A null text counts as empty; texts without a word share fingerprint zero and are linked. Equal
    texts have equal fingerprints; a component's id is its smallest non-null id, and rows without
    an id take it too. Repeated rows stay; an empty table gives an empty result; other columns are
    ignored.
    """
    return members(docs, text, id_col).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# --- near-duplicate groups ---------------------------------------------------------------------------------


def sketched(text: str, known: dict[bytes, int]) -> tuple[int, int, int]:
    """(fingerprint of the words, weighted by the root of their counts; two halves of the sketch of the different five-word shingles).

    The root keeps the commonest words of a language from deciding every bit.
    """
    words = text.encode().lower().split()
    if not words:
        return 0, 0, 0
    if len(known) > 300_000:
        known.clear()
    counts = Counter(words)
    for w in [w for w in counts if w not in known]:
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    fp = np.packbits(2 * (weights @ bits) > weights.sum(), bitorder="little").view(np.int64)[0]
    grams, _, _ = word_grams(text, NEAR_SHINGLE)
    if not len(grams):
        whole = b" ".join(words)
        grams = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64).view(np.int64)
    grams = np.unique(grams).view(np.uint64)
    with np.errstate(over="ignore"):
        other = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        other ^= other >> np.uint64(29)
    return int(fp), int(majority(grams)), int(majority(other))


def sketches(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, digest, fp, s1, s2) of every row."""
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    source = docs.select(docs[id_col].alias("id"), digest.alias("digest"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            made = np.array([sketched(t, known) for _, part in slices(batch.column("text")) for t in part], np.int64).reshape(-1, 3)
            columns = [batch.column("id"), batch.column("digest"), *[pa.array(np.ascontiguousarray(c)) for c in made.T]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "fp", "s1", "s2"])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, digest bigint, fp bigint, s1 bigint, s2 bigint")


def _bits(q: Column, first: Column, upto: Column) -> Column:
    """The bits of ``q`` from ``first`` up to, but without, ``upto``."""
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), upto - first) - 1
    return F.call_function("shiftrightunsigned", q, first).bitwiseAND(ones)


def _alike(a: str, b: str) -> Column:
    """Whether the nodes ``a`` and ``b`` are near duplicates: by their fingerprints, then by their sketches."""
    off = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (off("fp") <= NEAR) & (off("s1") + off("s2") <= NEAR_SKETCH)


def _buckets(level: DataFrame, width: int, parts: int, only: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """``level`` once for each pair (or each of ``only``) of the ``parts`` of the lowest ``width`` bits of its ``q``: ``at`` names the bucket, ``q`` becomes the bits that are left, lowest and in order."""
    bounds = [width * k // parts for k in range(parts + 1)]
    # The pairs are rows of places, so that one expression serves them all and the plans stay small.
    pairs = [
        F.struct(F.lit(a * parts + b).alias("pair"), *[F.lit(at).alias(n) for n, at in zip(("a", "a_end", "b", "b_end"), (*bounds[a : a + 2], *bounds[b : b + 2]))])
        for a in range(parts)
        for b in range(a + 1, parts)
        if not only or (a, b) in only
    ]
    keyed = level.select("at", "node", "q", "label", F.inline(F.array(*pairs)))
    q, a, a_end, b, b_end = (F.col(c) for c in ("q", "a", "a_end", "b", "b_end"))
    middle = F.call_function("shiftleft", _bits(q, a_end, b), a)
    high = F.call_function("shiftleft", _bits(q, b_end, F.lit(width)), a + b - a_end)
    left = _bits(q, F.lit(0), a).bitwiseOR(middle).bitwiseOR(high)
    return keyed.select(F.xxhash64("at", "pair", _bits(q, a, a_end), _bits(q, b, b_end)).alias("at"), "node", left.alias("q"), "label")


def _near_labels(found: DataFrame, steps: int = NEAR_STEPS) -> DataFrame:
    """(of, label): the least node within ``steps`` links. Nodes of one label are of one group; a group may have several labels."""
    both = found.select(F.col("a").alias("of"), F.col("b").alias("to")).union(found.select(F.col("b").alias("of"), F.col("a").alias("to")))
    labels = both.groupBy("of").agg(F.min("to").alias("least")).select("of", F.least("of", "least").alias("label"))
    for _ in range(steps - 1):
        labels = both.join(labels.select(F.col("of").alias("to"), "label"), "to").groupBy("of").agg(F.min("label").alias("label"))
    return labels


def _labelled(level: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``level`` with the label of each node, its own digest where it has none. Before nodes are dealt to buckets, so that each is looked up once."""
    if labels is None:
        return level.withColumn("label", F.col("node.digest"))
    named = level.join(labels.select("of", F.col("label").alias("_label")), F.col("node.digest") == F.col("of"), "left")
    return named.select("at", "node", "q", F.coalesce("_label", "node.digest").alias("label"))


def _several(keyed: DataFrame) -> DataFrame:
    """``keyed`` without the buckets whose nodes all have one label, with the bucket's size and its node of the greatest label."""
    several = keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max(F.struct("label", "node")).alias("top"))
    return keyed.join(several.filter("low <> top.label"), "at")


def _sizes(keyed: DataFrame) -> DataFrame:
    """(at, n): the size of each bucket whose nodes have several labels. No node is shuffled for it."""
    sizes = keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return sizes.filter("low <> high").select("at", "n")


def near_links(nodes: DataFrame, bucket: int = NEAR_BUCKET) -> DataFrame:
    """Pairs (a, b) of the nodes (digest, fp, s1, s2) that are near duplicates, enough of them to connect each group.

    Nodes meet in buckets of two equal parts of their fingerprints. First each bucket of a few pairs of
    parts links one node to all that are near duplicates of it, so a large group of near copies becomes a few stars
    and is never paired out. Pairs that are known to be of one group by then add nothing; of the
    others every one that meets in a bucket is checked, by the Hamming distance and the sketches. A
    bucket of more than ``bucket`` nodes that still holds several labels has its free bits cut
    again, so that its nodes meet in smaller buckets: equal parts are bound to exist there too, so
    no pair is lost.
    """
    # Equal fingerprints and sketches first: linked to the least text of theirs; that one stands for them.
    marks = ["fp", "s1", "s2"]
    least = nodes.groupBy(*marks).agg(F.min("digest").alias("first"))
    heads = stored(least.select(F.struct(F.col("first").alias("digest"), *marks).alias("node")))
    found = nodes.join(least, marks).filter("digest <> first").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    level = heads.select(F.lit(0).cast("bigint").alias("at"), "node", F.col("node.fp").alias("q"))
    # The node with the greatest label has another one than the node with the least.
    labels = None
    for only in NEAR_STARS:
        known = _several(_buckets(_labelled(level, labels), *NEAR_CUTS[0], only))
        star = known.filter((F.col("label") != F.col("top.label")) & _alike("node", "top.node"))
        ends = (F.least("node.digest", "top.node.digest").alias("a"), F.greatest("node.digest", "top.node.digest").alias("b"))
        found = stored(found.union(star.select(*ends)).distinct())
        labels = stored(_near_labels(found))
    level = stored(_labelled(level, labels))
    for width, parts in NEAR_CUTS:
        last = (width, parts) == NEAR_CUTS[-1]
        keyed = _buckets(level, width, parts)
        sizes = stored(_sizes(keyed))
        # Both sides of the pairs read one shuffle of the nodes, which is not stored.
        small = keyed.join(sizes if last else sizes.filter(F.col("n") <= bucket), "at").select("at", "node", "label")
        a, b = small.alias("a"), small.alias("b")
        pair = (F.col("a.at") == F.col("b.at")) & (F.col("a.label") < F.col("b.label")) & _alike("a.node", "b.node")
        found = found.union(a.join(b, pair).select(F.least("a.node.digest", "b.node.digest").alias("a"), F.greatest("a.node.digest", "b.node.digest").alias("b")))
        if not last:
            large = sizes.filter(F.col("n") > bucket)
            if large.isEmpty():
                break
            level = stored(keyed.join(large, "at", "left_semi"))
    return found.distinct()


def near_members(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, component) of every row; component is the smallest id of its group of near duplicates.

    A null text counts as empty; texts without a word are one group. Rows without an id take their
    group's; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    made = stored(sketches(docs, text, id_col))
    nodes = stored(made.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("fp", "s1", "s2")]))
    roots = components(near_links(nodes.select("digest", "fp", "s1", "s2"))).withColumnRenamed("fp", "digest")
    named = nodes.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ids = named.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("rows")).filter(F.col("rows") > 1).drop("rows")
    known = stored(named.join(ids, "root").select("digest", "component"))
    return made.select("id", "digest").join(known, "digest", "left").select("id", "digest", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is the smallest of their group of near duplicates, with all their columns.

    Rows that repeat an id and its text are one document and stay or go together. A row without
    an id goes only where a row with an id is in its group.
    """
    verdict = near_members(docs, text, id_col)
    gone = stored(verdict.filter(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct())
    return without(docs, gone, text, id_col)
