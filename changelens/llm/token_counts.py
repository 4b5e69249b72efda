"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Pre-tokens of many texts are one ragged array of symbols. In each round every sequence finds its
lowest-ranked pair and applies all its occurrences at once, left to right; sequences without a pair
are done, and their surviving symbols are their tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from changelens.llm.common import slices

# Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
CACHED_UNITS = 300_000
CACHED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character by which a vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary's merge ranks as sorted arrays; its size is fixed by the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.bytes = np.array([ids[s] for s in byte_symbols()], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        seq = np.repeat(np.arange(len(tokens)), size)
        ids = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        rank = np.full(len(ids), _NONE, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            out[seq[starts[done]]] = size[done]
            if done.any():
                live = np.repeat(~done, size)
                ids, seq, rank = ids[live], seq[live], rank[live]
                least, size = least[~done], size[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, size)
            # Equal pairs may overlap (a a a): in a run of hits every second one is taken, from the left.
            place = np.arange(len(ids))
            before = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - before) % 2 == 1
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.zeros(len(ids), bool)
            new[at] = True
            ids, seq, rank, new = ids[keep], seq[keep], rank[keep], new[keep]
            again = new.copy()
            again[:-1] |= new[1:]
            again = np.flatnonzero(again)
            last = np.append(seq[1:] != seq[:-1], True)[again]
            rank[again[last]] = _NONE
            again = again[~last]
            rank[again] = self.rank(ids[again], ids[again + 1])
        return out


class TokenCounter:
    """Counts tokens of texts; remembers the counts of short units, a bounded number of them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pre = regex.compile(PRE_TOKEN)
        self.gaps = re.compile(r"\s\s")
        self.split = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.known: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        """Pieces of a text that no pre-token crosses."""
        if self.gaps.search(text):
            return self.pre.findall(text)
        first, *rest = text.split(" ")
        return [first, *[f" {u}" for u in rest]] if first else [f" {u}" for u in rest]

    def learn(self, units: set[str]) -> dict[str, int]:
        units = list(units)
        pieces = [self.pre.findall(u) for u in units]
        number = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = self.merges.count([p.encode() for ps in pieces for p in ps])
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        ends = np.cumsum(number)
        return dict(zip(units, (total[ends] - total[ends - number]).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        made, extra = [], []
        for text in texts:
            parts, found = [text], 0
            if self.split is not None and self.split.search(text):
                parts = self.split.split(text)
                found = len(parts) - 1
            made.append([u for p in parts if p for u in self.units(p)])
            extra.append(found)
        new = set().union(*made) - self.known.keys() if made else set()
        counts = self.learn(new) if new else {}
        if len(self.known) + len(counts) > CACHED_UNITS:
            known = self.known | counts
            self.known = {}
        else:
            known = self.known
            known.update(counts)
        out = [n + sum(map(known.__getitem__, us)) for n, us in zip(extra, made)]
        for u in [u for u in counts if len(u) > CACHED_LENGTH]:
            self.known.pop(u, None)
        return out


def token_counts(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has no bytes and no tokens; a null id stays null; repeated rows stay; an
    empty table gives an empty result; other columns are ignored. Special strings in a text count
    as the one token they are. A text of any length is counted whole.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(merges.value)
        for batch in batches:
            texts = batch.column("text")
            counts = [n for _, part in slices(texts) for n in counter.count(part)]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = pa.array(counts, pa.int64())
            over = pc.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, tokens, over], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(source.dtypes)["id"]
    made = source.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return made.withColumnRenamed("id", id_col)
