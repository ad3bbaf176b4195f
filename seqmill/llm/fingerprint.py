"""Quartile bucket digests of whole texts, and their likeness.

Each window of five bytes gives up to six byte triplets; every triplet is hashed into one of
256 buckets. The digest holds a check byte, the logarithm of the length, two quartile ratios
and, for each bucket, in which quartile of all bucket counts it lies (two bits). Digests are
compared by a difference score that is bounded at `CAP`: likeness is 1 for equal digests and
0 from the cap on.

Cases: a null text is empty; texts under three bytes have empty buckets; equal texts have equal
digests; in comparisons with the next document, rows are in ascending doc_id (null first), ties
by text, repeated rows follow each other, rows of one doc_id are read by one task, the last is followed by the first, and a lone row by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, column

BUCKETS = 256
#: Where the bytes of a triplet stand in a window.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
CAP = 448
_PIECE = 1 << 20
_FIRST = -(2**63)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket; long texts are counted piece by piece."""
    counts = np.zeros(BUCKETS, np.int64)
    for begin in range(0, len(data), _PIECE):
        b = np.frombuffer(data[begin : begin + _PIECE + 4], np.uint8).astype(np.uint32)
        for i, (_, j, k) in enumerate(SHAPES):
            n = min(len(b) - k, _PIECE)
            if n > 0:
                v = b[:n] | (b[j : j + n] << np.uint32(8)) | (b[k : k + n] << np.uint32(16))
                counts += np.bincount(((v + np.uint32(i << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest_bytes(data: bytes) -> np.ndarray:
    """check, length, two ratios, then the buckets' quartiles, four to a byte."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    size = round(math.log(len(data)) / math.log(1.1)) % 256 if data else 0
    ratios = (int(q1 * 100 // q3) % 16, int(q2 * 100 // q3) % 16) if q3 else (0, 0)
    check = hashlib.blake2b(data, digest_size=1).digest()[0]
    return np.concatenate([np.array([check, size, ratios[0] << 4 | ratios[1]], np.uint8), body.astype(np.uint8)])


#: Difference of two quartiles; opposite ones count double.
_QUARTILES = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """The difference score of two digests, at most CAP."""
    total = int(a[0] != b[0])
    size = abs(int(a[1]) - int(b[1]))
    total += 2 * min(size, 256 - size)
    for shift in (4, 0):
        ratio = abs((int(a[2]) >> shift & 15) - (int(b[2]) >> shift & 15))
        total += min(ratio, 16 - ratio)
    for shift in (0, 2, 4, 6):
        total += int(_QUARTILES[a[3:] >> shift & 3, b[3:] >> shift & 3].sum())
    return min(total, CAP)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / CAP


def edited(text: str, following: str) -> str:
    """text, its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs, in one scan."""
    slim = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [digest_bytes(x.as_py().encode()).tobytes().hex() for x in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return slim.mapInArrow(found, T.StructType([slim.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


_COMPARED = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_COMPARED_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part; in each part the own rows in order, then the next part's first."""
    before: tuple | None = None
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _COMPARED}
        for part, tail, doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            own = digest_bytes(text.encode()) if not tail or before else None
            if before and before[0] == part:
                _, id_, x, a = before
                other = edited(x, text).encode()
                b = digest_bytes(other)
                row = (id_, len(x), hashlib.sha256(other).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, own))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            before = None if tail else (part, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _COMPARED.items()], names=list(_COMPARED))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document's digest against those of its edited text and of the next document.

    doc_id is cut into parts at its approximate quantiles, which are ids of the table, so the
    first document of each part is known: it is sent to its own part and, as a tail, to the
    part before. One shuffle, a task a part, then each part is read in order; nothing is gathered.
    """
    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_FIRST))
    parts = max(slim.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    cuts = slim.agg(F.min(key).alias("first"), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], F.lit(max(10_000, 20 * parts))).alias("cuts")).first()
    first = cuts["first"] if cuts["first"] is not None else _FIRST
    heads = np.array(sorted({first, *(cuts["cuts"] or ())}), np.int64)
    last = len(heads) - 1

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def parts_of(keys: pa.Array) -> pa.Array:
        """The part of a key; then the part before it, negative, if the key is a part's first."""
        k = keys.to_numpy(zero_copy_only=False)
        own = np.maximum(np.searchsorted(heads, k, side="right") - 1, 0)
        return pa.array([[p, -1 - ((p - 1) % (last + 1))] if head else [p] for p, head in zip(own.tolist(), (heads[own] == k).tolist(), strict=True)], pa.list_(pa.int32()))

    keyed = slim.withColumn("key", key).withColumn("parts", parts_of(F.col("key")))
    rows = keyed.select(F.explode("parts").alias("p"), "key", "doc_id", "text")
    rows = rows.select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("part"), (F.col("p") < 0).alias("tail"), "key", "doc_id", "text")
    dealt = rows.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "tail", "key", "text")
    return dealt.drop("key").mapInArrow(_compared, _COMPARED_DDL)
