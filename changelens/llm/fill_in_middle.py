"""Fill-in-the-middle samples: a wavelet matrix over character classes counts units and finds both cuts.

The bytes of many texts form one sequence of character classes. Units (lines, sentences, words) end
with a character of certain classes, so the boundaries up to a place are a sum of ranks, and the
place of the k-th boundary is found by bisection on that sum. Nothing is split to count units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices

SEED = "7"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Classes of the bytes of UTF-8. A byte within a character is a class of its own, so ranks give code points too.
OTHER, INNER, NEWLINE, BLANK, STOP = range(5)
LEVELS = 3
# The classes that end a unit; what follows the last of them is a unit as well.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK)}

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = INNER
_CLASS[10] = NEWLINE
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[[ord(c) for c in ".!?"]] = STOP


class Bits:
    """A bit vector that counts the ones before any place: packed words and one running count for each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of small codes: one bit vector for each bit of the code, rows with a zero moved before those with a one."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for k in range(levels - 1, -1, -1):
            ones = (codes >> k & 1).astype(bool)
            self.levels.append((k, Bits(ones)))
            codes = np.concatenate((codes[~ones], codes[ones]))

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` occurs before each place of ``at``."""
        low, high = np.zeros_like(at), at
        for k, bits in self.levels:
            if code >> k & 1:
                low, high = bits.zeros + bits.rank(low), bits.zeros + bits.rank(high)
            else:
                low, high = low - bits.rank(low), high - bits.rank(high)
        return high - low

    def boundaries(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(c, at) for c in codes)

    def after(self, codes: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in low..high before which ``count`` boundaries lie, or ``high`` where there are fewer."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            short = self.boundaries(codes, middle) < count
            low = np.where(open_ & short, middle + 1, low)
            high = np.where(open_ & ~short, middle, high)
        return low


def cuts(texts: list[bytes], codes: tuple[int, ...], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, cut after the prefix, after the middle, their code points) of every text.

    ``first`` and ``second`` are draws: the prefix ends after the smaller of first % (n + 1) and
    second % (n + 1) of the n units, the middle after the larger. Cuts are byte places in the text.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    classes = _CLASS[raw]
    matrix = WaveletMatrix(classes)
    end = np.cumsum(size)
    start = end - size
    before = matrix.boundaries(codes, start)
    inside = matrix.boundaries(codes, end) - before
    last = classes[np.maximum(end - 1, 0)] if len(raw) else np.zeros(len(texts), np.uint8)
    units = inside + ((size > 0) & ~np.isin(last, codes))
    a, b = first % (units + 1), second % (units + 1)
    one = matrix.after(codes, before + np.minimum(a, b), start, end)
    two = matrix.after(codes, before + np.maximum(a, b), start, end)
    inner = [matrix.rank(INNER, x) for x in (start, one, two)]
    return units, one - start, two - start, one - start - (inner[1] - inner[0]), two - one - (inner[2] - inner[1])


def draws(id_: Column, seed: str) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1, of the seed and the id (a null id is the word null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def filled_in_middle(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    unit: str = "line",
    percent: int = 100,
    spm_percent: int = 50,
    seed: str = SEED,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; n counts the units of the whole text.

    ``percent`` of the texts are cut, of these ``spm_percent`` with the suffix first. A text that is
    null, empty or holds one of the marks stays as it is (null: an empty text): form plain, no
    counts of prefix and middle. Repeated rows get equal results; an empty table gives an empty
    result; other columns are ignored.
    """
    codes = UNITS[unit]
    named = [d.alias(f"h{k}") for k, d in enumerate(draws(docs[id_col], seed), 1)]
    source = docs.select(docs[id_col].alias("id"), *named, docs[text].alias("text"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)])
            for at, part in slices(batch.column("text")):
                raw = [t.encode() for t in part]
                h1, h2, h3, h4 = drawn[:, at : at + len(raw)]
                n, one, two, chars_one, chars_two = cuts(raw, codes, h1, h2)
                plain = (h3 % 100 >= percent) | np.array([not t or any(m in t for m in marks) for t in raw])
                spm = h4 % 100 < spm_percent
                out = []
                for t, p, m, stays, suffix_first in zip(raw, one.tolist(), two.tolist(), plain.tolist(), spm.tolist()):
                    if stays:
                        out.append(t)
                    elif suffix_first:
                        out.append(b"".join((marks[1], t[m:], marks[0], t[:p], marks[2], t[p:m])))
                    else:
                        out.append(b"".join((marks[0], t[:p], marks[1], t[m:], marks[2], t[p:m])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                columns = [
                    batch.column("id").slice(at, len(raw)), pa.array(n), pa.array(form.tolist(), pa.string()),
                    pa.array(chars_one, mask=plain), pa.array(chars_two, mask=plain), pa.array(out, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(source.dtypes)["id"]
    made = source.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no piece holds a mark, so the marks cut it into its three pieces."""
    pieces = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    piece = lambda *order: F.concat(*[F.get(pieces, F.lit(k)) for k in order])
    return F.when(form == "plain", output).when(form == "psm", piece(1, 3, 2)).otherwise(piece(2, 3, 1))
