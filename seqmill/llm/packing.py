"""Best-fit decreasing packing of tokenised documents into windows of fixed capacity.

Each document is tokenised and closed with one end token. Documents longer than a window are
first cut into full windows; what remains is placed in order of falling length, each piece in
the open window that it fits most tightly. A segment tree indexed by remaining capacity finds
that window.

Packing is local to a Spark task, in blocks of `block_pieces` open pieces, so texts are never
shuffled and a task holds a few numbers for each open piece; each block leaves at most a few
windows with room. Sequence ids join the task's partition and a running number.

Cases: a null or empty text is the end token alone; texts of any length are tokenised whole, also one
endless word or run of blanks, and cut into full windows; a special token's string in a text gets that
token's id, as the tokenizer file has it, or is ordinary text with special=False; rows with the same doc_id are packed as documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column

CAPACITY = 1024
END_ID = 0
#: Fixed value: the only special token of byte_bpe_50k.json.
SPECIAL = {"<|endoftext|>": 50256}
_SPECIAL_PARTS = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


class OpenWindows:
    """Open windows by remaining capacity, over a segment tree of how many there are."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.tree[at] += by
            at >>= 1

    def push(self, window: int, room: int) -> None:
        self.held[room].append(window)
        self._count(room, 1)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """(window, room) with the least room that is at least size, or None; it is taken out."""
        at = self.leaves + size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.tree[2 * at])
        room = at - self.leaves
        self._count(room, -1)
        return self.held[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each piece, and how many windows there are; sizes are 1 to capacity."""
    windows, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened, n = OpenWindows(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = opened.pop_tightest(size)
        window, room = found or (n, capacity)
        n += found is None
        windows[i], offsets[i] = window, capacity - room
        if room > size:
            opened.push(window, room - size)
    return windows, offsets, n


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ranks file; one for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def default_ranks() -> str:
    """The ranks of byte_bpe_50k, which give the ids of byte_bpe_50k.json several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: White space of the pattern; a run of so many characters is one piece of the vocabulary's merges, found
#: without the pattern, whose search for the end of a run takes stack for every character.
_LONG_BLANKS = re.compile(r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def ordinary_ids(bpe, text: str) -> list[int]:
    """The ids of a text whose special strings are ordinary text; any run of blanks may be of any length."""
    ids, at = [], 0
    for run in _LONG_BLANKS.finditer(text):
        # the last blank of a run goes with the word after it, unless the text ends
        stop = run.end() - (run.end() < len(text))
        ids += bpe.encode_ordinary(text[at : run.start()]) + bpe._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + bpe.encode_ordinary(text[at:]) if at else bpe.encode_ordinary(text)


def token_ids(text: str, path: str, special: bool = False) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit numbers, closed with END_ID.

    special: whether SPECIAL's strings get their ids, as byte_bpe_50k.json does unless told not to.
    """
    bpe = encoder(path)
    ids: list[int] = []
    for part in _SPECIAL_PARTS.split(text) if special else [text]:
        ids += [SPECIAL[part]] if special and part in SPECIAL else ordinary_ids(bpe, part)
    ids.append(END_ID)
    return np.array(ids, "<u4")


_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, block_pieces: int = 1_000_000, special: bool = True) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    ranks = ranks or default_ranks()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        used = 0
        rest: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True) if pieces else [[]] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True)], names=list(_COLUMNS))

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal used, rest
            windows, offsets, n = best_fit_decreasing(np.array([p[2] for p in rest], np.int64), capacity)
            placed = [(*p, first + used + w, o) for p, w, o in zip(rest, windows.tolist(), offsets.tolist(), strict=True)]
            used, rest = used + n, []
            for at in range(0, len(placed), 50_000):
                yield rows(placed[at : at + 50_000])

        for batch in batches:
            full = []
            for doc_id, text in zip(batch.column(0).to_pylist(), column(batch, "text"), strict=True):
                ids = token_ids(text.as_py(), ranks, special)
                data, n = memoryview(ids.tobytes()), len(ids)
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    piece = (doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n)
                    if size == capacity:
                        full.append((*piece, first + used, 0))
                        used += 1
                    else:
                        rest.append(piece)
            yield rows(full)
            if len(rest) >= block_pieces:
                yield from closed()
        yield from closed()

    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(packed, _DDL)
