"""Constructs that moved within their file, and the bodies that are compared for it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.similarity import subsequence_length
from changelens.functions.text import strip_whitespace, text_lines
from changelens.operators import bitmaps as B
from changelens.operators.barrier import bind
from changelens.operators.entries import CosmeticConfig
from changelens.operators.outline import body_of


# Bytes of a digest.
DIGEST = 32


def region_bodies(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions with ``body``: the lines after the header, each with its newline. Regions without any are dropped.

    For regions that come from elsewhere; ``find_regions(files, bodies=True)`` cuts its own in the
    row. A version's regions meet its text as one array, so no line is shuffled by itself.
    """
    keys = ["path", "side"]
    others = [c for c in regions.columns if c not in keys]
    lists = regions.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_regions"))
    versions = [F.struct(F.lit(v).alias("side"), text_lines(f"{v}_content").alias("_lines")) for v in ("old", "new")]
    rows = files.select("path", F.inline(F.array(*versions))).join(lists, keys)

    # In the array, so that a row never carries the whole text once per region.
    def with_body(r: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in others], body_of("_lines", r["header_end_line"], r["end_line"]).alias("body"))

    bodies = rows.select(*keys, F.inline(F.transform("_regions", with_body)))
    return bodies.select(*regions.columns, "body").filter("body <> ''")


def _chooser(threshold: float) -> Callable:
    # Nested, so that workers get the code itself and need no copy of this package.
    length = subsequence_length

    def choose(old: list[tuple[int, int, bytes]], new: list[tuple[int, int, bytes]]) -> list[dict]:
        """Let the old regions of one name choose in order among the new ones that are still free."""
        same: dict[bytes, list[int]] = {}
        for j, (_, _, text) in enumerate(new):
            same.setdefault(text, []).append(j)
        sizes = np.array([len(text) for _, _, text in new])
        free = np.ones(len(new), bool)
        bytes_of: np.ndarray | None = None
        out = []
        for i, (start, end, a) in enumerate(old):
            # Nothing beats an equal body, and an empty one is like no other one.
            j = next((j for j in same.get(a, ()) if new[j][:2] != (start, end)), None)
            best = (1.0, j)
            if j is None and a:
                # The lengths, then the bytes in common, limit the similarity.
                able = np.flatnonzero(free & (np.minimum(sizes, len(a)) / np.maximum(sizes, len(a)) >= threshold))
                if bytes_of is None:
                    bytes_of = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for _, _, t in new]).astype(np.int32)
                shared = np.bincount(np.frombuffer(a, np.uint8), minlength=256)
                bound = np.minimum(bytes_of[able], shared).sum(axis=1) / np.maximum(sizes[able], len(a))
                best = (threshold, None)
                for k in np.argsort(-bound, kind="stable"):
                    j = int(able[k])
                    if bound[k] < best[0]:
                        break
                    if new[j][:2] == (start, end):
                        continue
                    longest = max(len(a), len(new[j][2]))
                    score = length(a, new[j][2], int(best[0] * longest)) / longest
                    if score > best[0] or (score == best[0] and (best[1] is None or j < best[1])):
                        best = (score, j)
            if best[1] is not None:
                free[best[1]] = False
                same[new[best[1]][2]].remove(best[1])
                out.append({"o": i, "n": best[1], "similarity": float(best[0])})
        return out

    return choose


def _chosen(old: str, new: str, threshold: float) -> Column:
    """Pairs (o, n, similarity) by place in two arrays of (start_line, level, end_line, text)."""
    choose = _chooser(threshold)

    def pairs(
        old_start: pd.Series, old_end: pd.Series, old_text: pd.Series, new_start: pd.Series, new_end: pd.Series, new_text: pd.Series
    ) -> pd.Series:
        def listed(starts, ends, texts):
            return [(int(s), int(e), t.encode()) for s, e, t in zip(starts, ends, texts)]

        columns = zip(old_start, old_end, old_text, new_start, new_end, new_text)
        return pd.Series([choose(listed(*c[:3]), listed(*c[3:])) for c in columns], dtype=object)

    parts = [F.col(side)[field] for side in (old, new) for field in ("start_line", "end_line", "text")]
    return F.pandas_udf(pairs, "array<struct<o:int,n:int,similarity:double>>")(*parts)


def _comparable(text: Column, threshold: float) -> Column:
    """What stands for a body: its digest, where it is so short that only an equal body reaches ``threshold``; else the body.

    One different byte costs 1 / length. A digest is as long as no other text that could come near it, and a body shorter
    than a digest stays as it is.
    """
    reach = int(1 / (1 - threshold)) - 1 if threshold < 1 else None
    length = F.octet_length(text)
    return F.when((length > DIGEST) & (F.lit(True) if reach is None else length < reach), F.md5(text.cast("binary"))).otherwise(text)


def moved_constructs(bodies: DataFrame, threshold: float = CosmeticConfig().move_similarity) -> DataFrame:
    """Old regions paired one to one with the new region of their file, name and kind that they moved to.

    Old regions choose in order: the most similar new region at another place that is still free,
    the first on ties. A choice depends on all earlier ones of its name, so these meet as one group:
    a piece of one file, which is a row already. Equal bodies meet by value, and a subsequence is
    computed only where lengths and bytes allow more than the best so far. A single region with an
    equal body is settled without the UDF. Regions with an empty ``body`` take no part. Where only
    equal bodies reach the threshold, digests are shuffled in their place.
    """
    keys = ["path", "name", "node_type"]
    bodies = bodies.filter("body <> ''")
    bodies = bind(bodies.select(*keys, "side", "start_line", "level", "end_line", "body"), text=strip_whitespace("body")).drop("body")
    region = F.struct("start_line", "level", "end_line", _comparable(F.col("text"), threshold).alias("text"))

    def of(side: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, region)))

    groups = bodies.groupBy(*keys).agg(of("old").alias("old"), of("new").alias("new"))
    groups = groups.filter((F.size("old") > 0) & (F.size("new") > 0))
    o, n = F.get("old", F.lit(0)), F.get("new", F.lit(0))
    single = (F.size("old") == 1) & (F.size("new") == 1) & (o["text"] == n["text"])
    moved = (o["start_line"] != n["start_line"]) | (o["end_line"] != n["end_line"])
    one = F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("n"), F.lit(1.0).alias("similarity")))
    none = F.filter(one, lambda _: F.lit(False))
    groups = bind(groups, settled=F.when(single, F.when(moved, one).otherwise(none)))
    # A UDF inside a CASE runs for every row, so settled groups hand it no regions.
    left = bind(
        groups,
        old_left=F.filter("old", lambda _: F.col("settled").isNull()),
        new_left=F.filter("new", lambda _: F.col("settled").isNull()),
    )
    pairs = left.withColumn("_chosen", _chosen("old_left", "new_left", threshold))
    pairs = bind(pairs, e=F.coalesce("settled", "_chosen")).select(*keys, "old", "new", F.explode("e").alias("e"))
    place = lambda side, end: F.get(F.col(side), F.col("e")[end])
    return pairs.select(
        *keys,
        place("old", "o")["start_line"].alias("old_start_line"),
        place("old", "o")["end_line"].alias("old_end_line"),
        place("new", "n")["start_line"].alias("new_start_line"),
        place("new", "n")["end_line"].alias("new_end_line"),
        F.col("e.similarity").alias("similarity"),
    )


def moved_line(points: DataFrame, moved: DataFrame, side: str = "old", line: str = "line") -> DataFrame:
    """Add ``moved``: the first moved construct whose old (or new) lines contain the row's line."""
    return B.best_interval(
        points, moved, ["path"], line, F.col(f"{side}_start_line"), F.col(f"{side}_end_line"),
        [F.col("old_start_line"), F.col("old_end_line"), F.col("name")],
        ["name", "old_start_line", "old_end_line", "new_start_line", "new_end_line"], "moved",
    )
