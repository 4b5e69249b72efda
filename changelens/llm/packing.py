"""Packing documents into sequences of a fixed length: best-fit decreasing with a segment tree over capacities.

Documents longer than a sequence are first cut into full ones. The rest of each document then goes,
longest first, into the open sequence with the least room that still holds it whole.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices, stored
from changelens.llm.token_counts import PRE_TOKEN, byte_symbols

WINDOW = 2048
END = 1
# Pieces that are packed together. Blocks are of about this size, so a task's memory does not grow with the input.
BLOCK_PIECES = 8192

_IDS = np.dtype("<u4")


class Encoder:
    """Ids of texts under the vocabulary of a ``tokenizers`` file, as little-endian unsigned 32-bit integers.

    The merges run in tiktoken, which takes half the time; the ids are those of ``tokenizers`` without
    begin and end, with special strings in a text as the one id they are.
    """

    def __init__(self, spec: str):
        read = json.loads(spec)
        ids = read["model"]["vocab"]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"]]
        # Ranks are the order of the merges, after the single bytes; ids are looked up afterwards.
        tokens = [*byte_symbols(), *[a + b for a, b in pairs]]
        special = {t["content"]: len(tokens) + k for k, t in enumerate(read.get("added_tokens", []))}
        self.id_of = np.array([*[ids[t] for t in tokens], *[t["id"] for t in read.get("added_tokens", [])]], _IDS)
        self.same = bool((self.id_of == np.arange(len(self.id_of))).all())
        self.merges = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks={raw(t): k for k, t in enumerate(tokens)}, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        found = np.array(self.merges.encode(text, allowed_special="all"), _IDS)
        return found if self.same else self.id_of[found]


@functools.lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def pieces(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and the end id, cut into windows; the last is the rest."""
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    last = np.array([end], _IDS)
    kind = dict(source.dtypes)["id"]
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # its size is fixed by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            for at, part in slices(batch.column("text")):
                row, start, length, crc, total, held = [], [], [], [], [], []
                for i, body in enumerate(part, at):
                    tokens = np.append(own.encode(body), last)
                    for place in range(0, len(tokens), window):
                        piece = tokens[place : place + window]
                        row.append(i)
                        start.append(place)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(tokens))
                        if ids:
                            held.append(piece.astype(np.int32))
                columns = [batch.column("id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if ids else "")
    return source.mapInArrow(run, fields)


class OpenSequences:
    """Open sequences by the room they have left, over which a segment tree finds the least room that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # how many open sequences there are below each node; leaf r: with room r
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, sequence: int, room: int) -> None:
        self.at[room].append(sequence)
        self._count(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(sequence, room) of the tightest open sequence with room for ``length``, which is open no more; None if there is none."""
        node = length + self.leaves
        if not self.tree[node]:
            # Up to the first ancestor that has anything to the right of this leaf, then down to the leftmost of that.
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.tree[node]:
                    node += 1
        room = node - self.leaves
        self._count(room, -1)
        return self.at[room].pop(), room

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of at most ``window``: longest first, equal ones in their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, made = OpenSequences(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = opened.take(length)
        if found is None:
            found = made, window
            made += 1
        at, room = found
        sequence[i], offset[i] = at, window - room
        if room > length:
            opened.add(at, room - length)
    return sequence, offset


def packed(
    docs: DataFrame,
    path: str,
    text: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    end: int = END,
    block_pieces: int = BLOCK_PIECES,
    ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every row.

    A null text counts as empty and is the end id alone; rows without an id and repeated rows are
    packed like any other, each on its own; an empty table gives an empty result; other columns are
    ignored. Pieces meet in blocks by a hash of their number, so equal documents do not meet in one
    task. Sequence ids are unique; those of one block follow one another.
    """
    cut = stored(pieces(docs, path, text, id_col, window, end, ids).withColumn("serial", F.monotonically_increasing_id()))
    blocks = max(1, -(-cut.count() // block_pieces))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)))
    names = [c for c in cut.columns if c not in ("serial", "block")]

    def pack(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, sort_keys=[("serial", "ascending")]))
        sequence, offset = best_fit(block.column("length").to_numpy(), window)
        number = block.column("block").to_numpy() << 32 | sequence
        return block.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"{n} {t}" for n, t in cut.dtypes if n in names)
    made = cut.groupBy("block").applyInArrow(pack, f"{fields}, sequence_id bigint, offset bigint")
    return made.withColumnRenamed("id", id_col)


def padding(used: int, window: int = WINDOW) -> int:
    """What a sequence is padded with: up to the window, but nothing at a power of two."""
    return 0 if used & (used - 1) == 0 else window - used


def sequences(placed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids) of ``packed(..., ids=True)``: each sequence's ids in order, padded but at a power of two.

    No sequence holds more than ``window`` ids, so no group is larger than that.
    """
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    own = held.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("own"))
    power = F.size("own").bitwiseAND(F.size("own") - 1) == 0
    missing = F.when(power, F.lit(0)).otherwise(F.lit(window) - F.size("own"))
    return own.select("sequence_id", F.size("own").alias("n_ids"), F.concat("own", F.array_repeat(F.lit(pad), missing)).alias("ids"))
