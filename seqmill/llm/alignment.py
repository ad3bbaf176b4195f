"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

A text is read as space + text. A is the byte-level BPE of a ranks file, B a sentencepiece model, which
adds the space itself. Tokens are intervals of bytes. All A and B tokens are lexsorted by start, the running
maximum of their ends is taken, and a group ends where the next token starts at or after it; within a group
each A token is linked with each B token.

Both tokenizers cut before a space that follows anything but white space, so a text is the row of its chunks
(white space, then a word), and a batch of texts aligns each different chunk once. That B never
joins a space to what is before it is checked on the model's pieces.

Counts of id pairs are of documents: each row of docs is a document. They are summed from the written pairs of
each document. The pairs of the highest counts, at most `HOT` of them, are looked up in a broadcast table whose
size that bounds; the others, of which none has more than 2 / HOT of all occurrences, are joined by a
shuffle, so all are exact and no pair is hot in a join. An A id's highest count is a number for each A id.

Cases: null and empty texts, and texts that B does not give back byte by byte (those with U+2581, which it reads as a
space), have no tokens: zeros, and '' for groups_sha256; strings of special tokens are plain text; texts of
any length are aligned whole; rows of one doc_id, null too, are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column, stash, text_slices
from .packing import default_ranks, encoder, ordinary_ids

#: Pairs whose counts are broadcast, 12 bytes each.
HOT = 1 << 18
#: Where a new chunk begins: a space after anything but white space.
_CHUNK = re.compile(r"(?<=\S)(?= )")
_SHIFT = 32


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces_of(path: str):
    """(processor, bytes of each piece); one for each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    told = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            told.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            told.append(b"")
        else:
            told.append(piece.replace("▁", " ").encode())
            if b" " in told[-1].lstrip(b" "):
                raise ValueError(f"{piece!r} joins a space to what is before it")
    return model, told


@dataclass
class Aligned:
    """The tokens and groups of some byte strings that lie one after another.

    a, b: ids; a_at, b_at: starts; a_group, b_group: the group of each token, ascending;
    opens: the start of each group.
    """

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    opens: np.ndarray


def coalesce(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Groups of two rows of tokens with sizes in bytes, both from byte 0 without gaps to the same end."""
    ends = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    starts = ends - np.concatenate([a_size, b_size])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order]) if len(order) else ends
    new = np.concatenate([[True], starts[order][1:] >= reached[:-1]]) if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return Aligned(a, b, starts[: len(a)], starts[len(a) :], group[: len(a)], group[len(a) :], starts[order][new])


def linked(t: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a id, b id) of all pairs of an A and a B token in one group."""
    n = len(t.opens)
    n_b = np.bincount(t.b_group, minlength=n)
    first = np.cumsum(n_b) - n_b
    times = n_b[t.a_group]
    owner = np.repeat(np.arange(len(t.a)), times)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    return t.a_group[owner], t.a[owner], t.b[first[t.a_group[owner]] + place]


@dataclass
class Chunks:
    """The chunks of some texts: codes of each text's chunks in order, and the different chunks with their tokens."""

    codes: np.ndarray
    bounds: np.ndarray
    chunks: list[str]
    good: np.ndarray
    aligned: Aligned
    a_bounds: np.ndarray
    b_bounds: np.ndarray


def aligned_chunks(texts: list[str], ranks: str, pieces: str) -> Chunks:
    """Texts cut into chunks, and each different chunk aligned; chunks that B changes have no tokens."""
    bpe, (model, told) = encoder(ranks), pieces_of(pieces)
    known: dict[str, int] = {}
    codes, bounds = [], [0]
    for text in texts:
        if text:
            codes += [known.setdefault(c, len(known)) for c in _CHUNK.split(" " + text)]
        bounds.append(len(codes))
    chunks = list(known)
    plain = bpe.encode_ordinary
    ids_a = [plain(c) if len(c) < 5000 else ordinary_ids(bpe, c) for c in chunks]
    # the model adds the space that each chunk begins with, but not to an empty text
    alone = model.piece_to_id("▁")
    ids_b = [ids if len(c) > 1 else [alone] for c, ids in zip(chunks, model.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
    raw = [c.encode() for c in chunks]
    good = np.array([b"".join([told[i] for i in ids]) == c for c, ids in zip(raw, ids_b, strict=True)], bool)
    ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good.tolist(), strict=True)] for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter((i for ids in side for i in ids), np.int64) for side in (ids_a, ids_b))
    size_b = np.array([*map(len, told)], np.int64)[flat_b] if len(flat_b) else flat_b
    sizes = _byte_sizes(ranks)[flat_a] if len(flat_a) else flat_a
    ends = (np.concatenate([[0], np.cumsum([*map(len, ids)])]).astype(np.int64) for ids in (ids_a, ids_b))
    return Chunks(np.array(codes, np.int64), np.array(bounds, np.int64), chunks, good, coalesce(flat_a, sizes, flat_b, size_b), *ends)


@lru_cache(maxsize=2)
def _byte_sizes(ranks: str) -> np.ndarray:
    """The bytes of each A id."""
    bpe = encoder(ranks)
    return np.array([len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)], np.int64)


def _strung(t: Chunks) -> list[str]:
    """`a1,a2|b1;a3|b2` of each chunk."""
    g, out = t.aligned, []
    n = len(g.opens)
    a_end, b_end = (np.cumsum(np.bincount(x, minlength=n)).tolist() for x in (g.a_group, g.b_group))
    a, b = [*map(str, g.a.tolist())], [*map(str, g.b.tolist())]
    groups, at, bt = [], 0, 0
    for i, j in zip(a_end, b_end, strict=True):
        groups.append((a[at] if i == at + 1 else ",".join(a[at:i])) + "|" + (b[bt] if j == bt + 1 else ",".join(b[bt:j])))
        at, bt = i, j
    per = _groups_per_chunk(t)
    at = 0
    for k in per.tolist():
        out.append(groups[at] if k == 1 else ";".join(groups[at : at + k]))
        at += k
    return out


def _groups_per_chunk(t: Chunks) -> np.ndarray:
    """How many groups each chunk has; groups never cross chunks."""
    chunk = np.repeat(np.arange(len(t.chunks)), np.diff(t.a_bounds))
    first = np.flatnonzero(np.diff(t.aligned.a_group, prepend=-1))
    return np.bincount(chunk[first], minlength=len(t.chunks))


_ALIGNED = {"row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
_DDL = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def _digest(texts: list[str], ranks: str, pieces: str) -> list:
    """The columns of _ALIGNED after doc_id, for some texts."""
    t = aligned_chunks(texts, ranks, pieces)
    parent = np.repeat(np.arange(len(texts)), np.diff(t.bounds))
    bad = np.zeros(len(texts), bool)
    bad[parent[~t.good[t.codes]]] = True
    codes, parent = t.codes[~bad[parent]], parent[~bad[parent]]
    total = lambda per: np.bincount(parent, weights=per[codes], minlength=len(texts)).astype(np.int64)
    strung = _strung(t)
    shas = ["" if bad[i] or lo == hi else hashlib.sha256(";".join([strung[c] for c in t.codes[lo:hi].tolist()]).encode()).hexdigest() for i, (lo, hi) in enumerate(zip(t.bounds.tolist(), t.bounds[1:].tolist(), strict=False))]
    # pairs of each different chunk, then of each document by its different chunks
    group, a, b = linked(t.aligned)
    per_group = _groups_per_chunk(t)
    chunk = np.repeat(np.arange(len(t.chunks)), per_group)[group]
    links = np.bincount(chunk, minlength=len(t.chunks))
    at = np.cumsum(links) - links
    keys = a << 15 | b
    seen, times = np.unique(parent << _SHIFT | codes, return_counts=True)
    of, code = seen >> _SHIFT, seen & (1 << _SHIFT) - 1
    n = links[code]
    place = np.repeat(at[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both = np.repeat(of, n) << _SHIFT | keys[place]
    order = np.argsort(both, kind="stable")
    both, weight = both[order], np.repeat(times, n)[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    sums = np.add.reduceat(weight, first) if len(first) else weight
    cut = np.searchsorted(both[first] >> _SHIFT, np.arange(len(texts) + 1))
    pairs, counts = (both[first] & (1 << _SHIFT) - 1).astype("<u4"), sums.astype("<u4")
    held = [(pairs[i:j].tobytes(), counts[i:j].tobytes()) for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
    return [total(np.diff(t.a_bounds)), total(np.diff(t.b_bounds)), total(per_group), total(links), shas, *zip(*held, strict=True)]


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """Written, one row a document: row (a number of its own), doc_id, counts, groups_sha256, and its different pairs with their times.

    pairs: little-endian 32-bit A id * 2^15 + B id, ascending; times: how often each is linked.
    """
    ranks, pieces = ranks or default_ranks(), pieces or default_pieces()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for at, n in text_slices(texts, 4 << 20):
                told = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), *_digest(texts.slice(at, n).to_pylist(), ranks, pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, _ALIGNED.values(), strict=True)], names=list(_ALIGNED))

    slim = bounded(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(slim.mapInArrow(aligned, _DDL), "aligned")


def groups_of(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id and groups of each row: array of (start, a, b): the first byte in space + text, and the ids of both sides."""
    ranks, pieces = ranks or default_ranks(), pieces or default_pieces()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for i in range(len(texts)):
                t = aligned_chunks([texts[i].as_py()], ranks, pieces)
                groups: list[dict] = []
                if t.good.all():
                    g, base = t.aligned, 0
                    a_cut, b_cut = (np.searchsorted(x, np.arange(len(g.opens) + 1)) for x in (g.a_group, g.b_group))
                    of_chunk = np.concatenate([[0], np.cumsum(_groups_per_chunk(t))])
                    size = [len(c.encode()) for c in t.chunks]
                    begin = np.concatenate([[0], np.cumsum(size)])
                    for c in t.codes.tolist():
                        for k in range(of_chunk[c], of_chunk[c + 1]):
                            groups.append({"start": base + int(g.opens[k] - begin[c]), "a": g.a[a_cut[k] : a_cut[k + 1]].tolist(), "b": g.b[b_cut[k] : b_cut[k + 1]].tolist()})
                        base += size[c]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([groups], kind)], names=["doc_id", "groups"])

    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(told, "doc_id bigint, groups array<struct<start: bigint, a: array<int>, b: array<int>>>")


_KEPT = list(_ALIGNED)[:-2]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and in how many of a task's documents it is, summed over a few million pairs at a time."""
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.empty(0, "<u4"), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    for batch in batches:
        held += [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(0)]
        if sum(map(len, held)) >= 1 << 22:
            yield summed()
    yield summed()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Written: key and in how many documents it is linked."""
    partial = bounded(aligned.select("pairs")).mapInArrow(_pair_counts, "key bigint, n bigint")
    return stash(partial.groupBy("key").agg(F.sum("n").alias("n")), "counts")


def _threshold(counts: DataFrame, hot: int) -> int:
    """The least power of two that at most `hot` pairs reach; 64 rows come to the driver."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()}
    above, power = 0, max(sizes, default=0) + 1
    while power > 0 and above + sizes.get(power - 1, 0) <= hot:
        power -= 1
        above += sizes.get(power, 0)
    return 1 << power


def _looked_up(keys: np.ndarray, counts: np.ndarray, highest: np.ndarray):
    """Rows with the sums over pairs in the table, and the pairs that are not."""
    best = highest[keys >> 15] == counts if len(keys) else np.empty(0, bool)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            own = [np.frombuffer(x.as_buffer(), "<u4") for x in get("pairs")]
            times = np.frombuffer(b"".join(get("times").to_pylist()), "<u4").astype(np.int64)
            flat = np.concatenate(own).astype(np.int64)
            owner = np.repeat(np.arange(len(own)), [*map(len, own)])
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            n, top = (np.zeros(len(flat), np.int64) for _ in range(2))
            n[known], top[known] = counts[at[known]], best[at[known]]
            sums = [np.zeros(len(own), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, top * times)
            np.add.at(sums[1], owner, n * times)
            cut = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=len(own)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(flat[~known]), pa.array(times[~known])], ["key", "times"]))
            yield pa.RecordBatch.from_arrays([*map(get, _KEPT), pa.array(sums[0]), pa.array(sums[1]), rest], names=[*_KEPT, "n_best", "count_sum", "rest"])

    return told


def score(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """aligned without its pairs, with n_best and count_sum."""
    counts = pair_counts(aligned)
    least = _threshold(counts, hot)
    highest = np.zeros(1 << 17, np.int64)
    of_a = counts.groupBy(F.shiftright("key", 15).alias("a")).agg(F.max("n").alias("n"))
    for a, n in of_a.collect():  # at most a row for each id of A's vocabulary
        highest[a] = n
    table = counts.filter(F.col("n") >= least).toArrow().sort_by("key")
    told = _DDL.replace("pairs binary, times binary", "n_best bigint, count_sum bigint, rest array<struct<key: bigint, times: bigint>>")
    found = stash(bounded(aligned).mapInArrow(_looked_up(table["key"].to_numpy(), table["n"].to_numpy(), highest), told), "found")
    best_of = stash(of_a.withColumnRenamed("n", "highest"), "highest")
    cold = counts.filter(F.col("n") < least).join(F.broadcast(best_of), F.shiftright("key", 15) == F.col("a")).select("key", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    rest = found.select("row", F.inline("rest")).join(cold, "key").groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return found.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more"), "groups_sha256")
