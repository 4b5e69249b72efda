"""Blocked scans, bitmaps and lookups against plain loops, with small blocks and one dominant key."""

import random

from pyspark.sql import functions as F

from changelens.operators import bitmaps as B
from changelens.operators import joins as J
from changelens.operators.scan import Fold, last_known, neighbours, running


def skewed(rng, count):
    """Rows of which a third share the key "hot"."""
    keys = ["hot" if rng.random() < 0.33 else f"k{rng.randrange(20)}" for _ in range(count)]
    seen: dict[str, int] = {}
    rows = []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        reset = rng.randrange(100) if rng.random() < 0.15 else None
        rows.append((k, seen[k], rng.choice([None, *range(-5, 6)]), reset))
    return rows


def test_running_folds(spark):
    rows = skewed(random.Random(1), 3000)
    frame = spark.createDataFrame(rows, "k string, pos bigint, v bigint, r bigint").repartition(7)
    folds = [
        Fold("total", F.col("v")),
        Fold("top", F.col("v"), "max"),
        Fold("low", F.col("v"), "min"),
        Fold("since", F.col("v"), "sum", F.col("r")),
        Fold("peak", F.col("v"), "max", F.col("r")),
        last_known("known", F.col("r")),
    ]
    got = {(r.k, r.pos): r for r in running(frame, ["k"], "pos", folds, block_rows=16).collect()}
    assert len(got) == len(rows)
    state: dict[str, dict] = {}
    for k, pos, v, r in sorted(rows):
        s = state.setdefault(k, dict.fromkeys(["total", "top", "low", "since", "peak", "known"]))

        def fold(old, new, f):
            return new if old is None else old if new is None else f(old, new)

        s["total"] = fold(s["total"], v, lambda a, b: a + b)
        s["top"] = fold(s["top"], v, max)
        s["low"] = fold(s["low"], v, min)
        s["since"] = fold(r if r is not None else s["since"], v, lambda a, b: a + b)
        s["peak"] = fold(r if r is not None else s["peak"], v, max)
        s["known"] = r if r is not None else s["known"]
        row = got[k, pos]
        for name, value in s.items():
            assert row[name] == value, (k, pos, name)


def test_running_backwards_with_ties(spark):
    rows = [("a", -5, 1, None), ("a", -5, 0, 7), ("a", -3, 1, None), ("a", -9, 0, 4), ("a", -9, 1, None), ("b", -1, 1, None)]
    frame = spark.createDataFrame(rows, "k string, pos bigint, ask int, ord bigint")
    got = running(frame, ["k"], "pos", [Fold("best", F.col("ord"), "min")], tie=["ask"], block_rows=2)
    assert {(r.k, r.pos): r.best for r in got.filter("ask = 1").collect()} == {
        ("a", -9): 4, ("a", -5): 4, ("a", -3): 4, ("b", -1): None
    }


def test_running_shuffles_by_key_and_block(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("pos"))
    plan = running(frame, ["k"], "pos", [Fold("n", F.lit(1).cast("bigint"))])._jdf.queryExecution().executedPlan().toString()
    # Only the totals of the blocks are gathered by key alone.
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line]
    assert any("_block" in line for line in wide)
    assert "SinglePartition" not in plan


def test_neighbours(spark):
    frame = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(23)], "k string, pos bigint, v string")
    for size in (1, 2, 5, 100):
        rows = neighbours(frame, ["k"], "pos", {"p": "v"}, {"n": "v"}, block_rows=size).collect()
        assert len(rows) == 46
        for r in rows:
            assert r.p == (f"{r.k}{r.pos - 1}" if r.pos else None)
            assert r.n == (f"{r.k}{r.pos + 1}" if r.pos < 22 else None)


def random_ranges(rng, count):
    rows = []
    for i in range(count):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(4)}"
        start = rng.randrange(1, 400)
        rows.append((key, i, start, start + rng.choice([-1, 0, 3, 59, 60, 61, 200])))
    return rows


def test_bitmaps_and_lookups(spark):
    rng = random.Random(4)
    ranges = random_ranges(rng, 120)
    lines = [(k, n) for k in ("hot", "k0", "k1", "k2", "k3", "none") for n in range(0, 640)]
    r = spark.createDataFrame(ranges, "k string, id bigint, lo bigint, hi bigint")
    p = spark.createDataFrame(lines, "k string, line bigint")

    bitmap = B.range_bitmap(r, ["k"], F.col("lo"), F.col("hi"), "hit")
    got = {(x.k, x.line): x.hit for x in B.flag_lines(p, bitmap, ["k"], "line", "hit").collect()}
    best = B.best_interval(p, r, ["k"], "line", F.col("lo"), F.col("hi"), [-F.col("lo"), F.col("id")], ["id"], "b")
    picked = {(x.k, x.line): (x.b.id if x.b else None) for x in best.collect()}
    for k, n in lines:
        inside = [x for x in ranges if x[0] == k and x[2] <= n <= x[3]]
        assert got[k, n] is bool(inside)
        assert picked[k, n] == (min(inside, key=lambda x: (-x[2], x[1]))[1] if inside else None)

    # Counting lines of a set per range, a range over many buckets and an empty one included.
    chosen = {(k, n) for k, n in lines if rng.random() < 0.3}
    sets = B.line_bitmaps(spark.createDataFrame(sorted(chosen), "k string, line bigint"), ["k"], "line", {"s": F.lit(True)})
    parts = B.spread(r, F.col("lo"), F.col("hi"), keep_empty=True).join(sets, ["k", "_bucket"], "left")
    both = F.coalesce("s", F.lit(0).cast("bigint")).bitwiseAND(F.col("_cover"))
    counts = parts.groupBy("id").agg(
        F.sum(B.count_bits(both)).alias("n"), F.min(B.first_line(both, F.col("_bucket"))).alias("first")
    )
    found = {x.id: (x.n, x.first) for x in counts.collect()}
    for k, i, lo, hi in ranges:
        inside = sorted(n for key, n in chosen if key == k and lo <= n <= hi)
        assert found[i] == (len(inside), inside[0] if inside else None)


def test_lookup_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, id bigint")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v bigint")
    got = {r.id: r.v for r in J.salted_lookup(rows, lookup, ["k"], ["id"], salts=5).collect()}
    assert got == {i: (1 if i % 3 else 2 if i == 3 else None) for i in range(300)}
    missing = J.salted_lookup(rows, lookup, ["k"], ["id"], how="left_anti", salts=5)
    assert missing.count() == 99


def test_ordered_concat_in_parts(spark):
    pieces = [("hot", i, f"<{i}é>") for i in range(200)] + [("one", 5, "b"), ("one", 2, "a"), ("none", 1, None)]
    frame = spark.createDataFrame(pieces, "k string, pos bigint, t string").repartition(5)
    rows = J.ordered_concat(frame, ["k"], "pos", F.col("t"), "text", part_bytes=64, block_rows=16).orderBy("k", "part").collect()
    hot = [r for r in rows if r.k == "hot"]
    assert len(hot) > 10 and [r.part for r in hot] == list(range(len(hot)))
    assert "".join(r.text for r in hot) == "".join(t for k, _, t in pieces if k == "hot")
    assert max(len(r.text.encode()) for r in hot) <= 72
    assert [(r.part, r.text) for r in rows if r.k == "one"] == [(0, "ab")]
