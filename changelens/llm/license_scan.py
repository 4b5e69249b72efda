"""License scan: MinHash bands over overlapping windows find templates, exact containment verifies; DataFrame functions only.

Shingles are five words. A window is ``WINDOW`` shingles from every place of a text on; templates
are cut into windows of the same size. Two windows meet where one of ``BANDS`` minimum hashes, each
a band of one row, is equal. A window that shares a third of its shingles (a one-shingle template
inside it) meets its template with probability 1 - (2/3)^12 > 0.992 and is tried at each of three
places; an unchanged stretch of seven words always meets. A retrieved template is scored once for each
text, over all shingles of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import lower_ascii, words_of
from changelens.operators.barrier import bind

SHINGLE = 5
WINDOW = 3
BANDS = 12
# Template windows start at every so many words; each is one row per band of the (bounded) template table.
STRIDE = 8
CONTAINMENT = 0.8
PUNCTUATION = ".,;:!?()[]{}<>\"'*#/"

# Public notices, as written by their stewards.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
# A template table above this is refused: its bands are sent to every task.
MOST_TEMPLATES = 10_000


def compared_words(text: Column) -> Column:
    return words_of(F.translate(lower_ascii(text), PUNCTUATION, ""))


def shingled(rows: DataFrame) -> DataFrame:
    """Add ``h``: the hashes of the five-word shingles of ``words``, by doubling (two words, four, five)."""

    def joined(a: str, b: str, shift: int, span: int) -> Column:
        n = F.greatest(F.size("words") - span + 1, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))

    rows = bind(rows, _one=F.transform("words", lambda w: F.xxhash64(w)))
    rows = bind(rows, _two=joined("_one", "_one", 1, 2))
    rows = bind(rows, _four=joined("_two", "_two", 2, 4))
    rows = bind(rows, h=joined("_four", "_one", 4, SHINGLE))
    return rows.drop("_one", "_two", "_four")


def band(k: int) -> Column:
    """Minimum of the k-th hash over the window's shingles x0, x1, x2."""
    salt = F.lit(((k + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)).cast("bigint")
    return F.least(*[F.xxhash64(F.col(f"x{j}").bitwiseXOR(salt)) for j in range(WINDOW)])


def windows(rows: DataFrame) -> DataFrame:
    """One row per place of ``h``; a window that reaches over the end repeats its first shingle."""
    placed = rows.select("*", F.posexplode("h").alias("pos", "x0"))
    return placed.select("*", *[F.coalesce(F.get("h", F.col("pos") + j), F.col("x0")).alias(f"x{j}") for j in range(1, WINDOW)])


def template_tables(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, grams, k, value): a row for each band of each template window; grams are all shingles of the template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} can be sent to every task")
    given = spark.createDataFrame(sorted(templates.items()), "template string, t string")
    rows = shingled(given.select("template", compared_words(F.col("t")).alias("words")))
    cut = windows(rows).filter((F.col("pos") % STRIDE == 0) & (F.size("h") > 0))
    bands = F.array(*[F.struct(F.lit(k).alias("k"), band(k).alias("value")) for k in range(BANDS)])
    return cut.select("template", F.col("h").alias("grams"), F.inline(bands))


def licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, digest, license, containment, word) for each template that a row holds; word is where
    its first shingle is found, from 0.

    Containment is the share of the template's shingles found in the whole text, wherever they are;
    a template whose first shingle is not in the text has no word. Case and punctuation do not count. A null, empty or short text holds none, nor does a
    template under five words; rows that repeat an id and its text give one row per template; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    table = template_tables(spark, TEMPLATES if templates is None else templates)
    known = table.select("k", "value").distinct().collect()  # BANDS values for each template window
    values = {k: sorted(r["value"] for r in known if r["k"] == k) for k in range(BANDS)}
    whole = table.select("template", "grams").distinct().collect()
    shingles, firsts = sorted({x for r in whole for x in r["grams"]}), sorted({r["grams"][0] for r in whole})
    body = F.coalesce(docs[text], F.lit(""))
    rows = shingled(docs.select(docs[id_col].alias("id"), F.xxhash64(body).alias("digest"), compared_words(body).alias("words")))
    # Of a text only the shingles that some template has go on, and where the templates' first ones are.
    shared = F.filter(F.array_distinct("h"), lambda x: x.isin(shingles))
    rows = bind(rows.select("id", "digest", "h"), shared=shared).filter(F.size("shared") > 0)
    starts = F.transform(F.filter("shared", lambda x: x.isin(firsts)), lambda x: F.struct(x.alias("h"), F.array_position("h", x).alias("at")))
    rows = bind(rows, starts=starts)
    met = F.lit(False)
    for k in range(BANDS):
        met = met | band(k).isin(values[k])
    found = windows(rows).filter(met)
    bands = F.array(*[F.struct(F.lit(k).alias("k"), band(k).alias("value")) for k in range(BANDS)])
    found = found.select("id", "digest", "shared", "starts", F.inline(bands))
    # The template table is bounded by MOST_TEMPLATES, so it goes to every task and texts stay where they are.
    pairs = found.join(F.broadcast(table.select("template", "k", "value").distinct()), ["k", "value"])
    pairs = pairs.groupBy("id", "digest", "template").agg(F.first("shared").alias("shared"), F.first("starts").alias("starts"))
    pairs = pairs.join(F.broadcast(table.select("template", "grams").distinct()), "template")
    share = F.size(F.array_intersect("shared", "grams")) / F.size(F.array_distinct("grams"))
    first = F.get(F.filter("starts", lambda x: x["h"] == F.get("grams", F.lit(0))), F.lit(0))["at"] - 1
    best = pairs.select("id", "digest", "template", share.alias("containment"), first.cast("bigint").alias("word")).filter(F.col("containment") >= containment)
    return best.select(F.col("id").alias(id_col), "digest", F.col("template").alias("license"), "containment", "word")
