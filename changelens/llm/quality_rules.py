"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed. A line that many different documents of one host repeat is
boilerplate of that host and is taken out; a document with too little left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import SPACES, let, lower_ascii, stored, words_of
from changelens.operators.barrier import bind

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# A line in more different documents of one host than this is taken out of them.
LINE_DOCS = 5


def repeated_words(hashes: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur twice or more in the text, from the words' hashes.

    Windows are compared by a 64-bit hash, built by doubling (two words, four, eight). Equal ones
    are found by sorting (hash, place); their places then cover up to eight words each.
    """

    def joined(a: Column, width: int) -> Column:
        right = F.slice(a, F.lit(width + 1), F.greatest(F.size(a) - width, F.lit(0)))
        left = F.slice(a, F.lit(1), F.greatest(F.size(a) - width, F.lit(0)))
        return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))

    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1

        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"], F.lit(False))

        places = F.filter(F.sequence(F.lit(0), last), lambda i: same(i, i - 1) | same(i, i + 1))
        places = F.array_sort(F.transform(places, lambda i: F.get(sorted_windows, i)["p"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("bigint"),
                lambda acc, n: acc + n,
            ),
        )

    def of_windows(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(placed, covered))

    pairs = F.when(F.size(hashes) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))
    two = let(pairs, lambda one: joined(one, 1))
    return let(two, lambda two: let(joined(two, 2), lambda four: let(joined(four, 4), of_windows)))


def normalised(line: Column) -> Column:
    """A line as it is compared across documents: lower case, digits as 0, one blank between words."""
    plain = F.translate(lower_ascii(line), "123456789" + SPACES, "0" * 9 + " " * len(SPACES))
    return F.array_join(F.array_remove(F.split(plain, " "), ""), " ")


def document_rows(docs: DataFrame, text: str, id_col: str, host: str) -> DataFrame:
    """One row per row of ``docs``: id, host, digest, the base measures, its lines as (hash, words), and ``row``, all of it."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(docs[id_col].alias("id"), docs[host].cast("string").alias("host"), F.coalesce(docs[text], F.lit("")).alias("t"), row)
    rows = bind(rows, lines=F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != ""), words=words_of(F.col("t")))
    words = F.transform("words", lambda w: F.xxhash64(w))
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("n"))
    return rows.select(
        "id", "host",
        F.xxhash64("t").alias("digest"),
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        let(words, repeated_words).alias("n_repeat_words"),
        F.transform("lines", line).alias("lines"), "row",
    )


def numbered(rows: DataFrame) -> DataFrame:
    """The rows stored with ``row_id``, a number of their own that stays as it is once written."""
    return stored(rows.withColumn("row_id", F.monotonically_increasing_id()))


def frequent_lines(rows: DataFrame, line_docs: int) -> DataFrame:
    """(host, h): the line hashes found in more than ``line_docs`` different documents of a host, whatever the host's size.

    Exact copies count once. Every count is combined before it is shuffled.
    """
    seen = rows.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    docs_of_line = seen.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    return docs_of_line.filter(F.col("docs") > line_docs).select("host", "h")


def removed_lines(rows: DataFrame, line_docs: int) -> DataFrame:
    """(row_id, gone, frequent) of the stored rows that lose lines: the words of these lines and their hashes.

    Lines meet the frequent ones by a join on host and hash, so a host's list is never in one place.
    Only rows with such a line carry an array, of at most their own lines.
    """
    frequent = stored(frequent_lines(rows, line_docs)).alias("f")
    lines = rows.select("row_id", "host", F.explode("lines").alias("x")).groupBy("row_id", "host", F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n")).alias("l")
    met = lines.join(frequent, F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.h") == F.col("f.h")))
    return stored(met.groupBy("l.row_id").agg(F.sum("n").alias("gone"), F.collect_list("l.h").alias("frequent")))


def judged(joined: DataFrame, least_words: int, least_left: float, repeated_percent: int) -> DataFrame:
    """Rows with ``gone``, the words that they lose or null, with base_failed, n_removed and kept."""
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeated_percent)
    left = F.col("n_words") - F.col("n_removed")
    kept = ~F.col("base_failed") & (left >= least_words) & (left >= F.col("n_words") * F.lit(least_left))
    return joined.withColumns({"base_failed": failed, "n_removed": F.coalesce("gone", F.lit(0).cast("bigint"))}).withColumn("kept", kept)


def with_loses(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Add ``loses``, whether ``gone`` has the row's number.

    Numbers run on inside a partition, so 64 rows are one bitmap: a bit for each row, and a join that moves no text until
    the bitmaps are too large to broadcast.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("row_id").bitwiseAND(F.lit(63)).cast("int"))
    maps = stored(gone.groupBy(F.shiftright("row_id", 6).alias("_at")).agg(F.bit_or(bit).alias("_bits")))
    joined = rows.join(maps, F.shiftright("row_id", 6) == F.col("_at"), "left")
    return joined.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("loses"))


def quality(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    least_words: int = 20,
    least_left: float = 0.2,
    repeated_percent: int = 30,
) -> DataFrame:
    """The measures and the verdict of every row.

    ``kept`` is false where the base rules fail, or where, without the frequent lines of the host,
    fewer than ``least_words`` words or less than ``least_left`` of all words are left.
    A null text counts as empty and fails; rows without a host form one host; repeated rows stay
    and get equal verdicts; an empty table gives an empty result; other columns are ignored.
    """
    rows = numbered(document_rows(docs, text, id_col, host).drop("row"))
    verdicts = judged(rows.join(removed_lines(rows, line_docs), "row_id", "left"), least_words, least_left, repeated_percent)
    return verdicts.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept"
    )


def kept_documents(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    least_words: int = 20,
    least_left: float = 0.2,
    repeated_percent: int = 30,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; their texts go without the frequent lines of the host.

    Blank lines stay. The rows are stored once with their measures; only those that lose lines meet these by their number,
    so the texts of the others are not shuffled.
    """
    rows = numbered(document_rows(docs, text, id_col, host))
    gone = removed_lines(rows, line_docs)
    told = with_loses(rows, gone)

    def kept(joined: DataFrame, body: Column) -> DataFrame:
        stay = judged(joined, least_words, least_left, repeated_percent).filter("kept")
        return stay.select(*[(body if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])

    own = F.col("row").getField(text)
    held = lambda x: F.array_contains("frequent", F.xxhash64(normalised(x)))
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x: ~held(x)), "\n")
    cleaned = F.when(F.col("n_removed") > 0, left).otherwise(own)
    whole = told.filter(~F.col("loses")).withColumn("gone", F.lit(None).cast("bigint"))
    # Merged at every size: what is shuffled then follows the input from small tables on, and no table of lines goes to every task.
    return kept(told.filter("loses").join(gone.hint("merge"), "row_id"), cleaned).unionByName(kept(whole, own))
