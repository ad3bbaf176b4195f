"""BAM files in parts: an index of records' places made by many tasks, and reads of a region from its blocks alone.

A BGZF file is a row of blocks that unpack on their own, but records cross blocks and nothing marks where one
begins. `index_bam` cuts files into splits of compressed bytes. The task of a split looks for the first block in
it, guesses where a record begins there (one whose fields agree, and whose followers' fields do), and walks from record to record
until one begins in the next split. A guess is never trusted: where the walk of the splits before ended must be where a split
began, and splits for which that does not hold are walked anew from there, until all do. So the index is exact.

A row of the index is a run of records on one reference: where it begins and ends as virtual offsets (the block's
place in the file * 2^16 + the place in the unpacked block), its least position and its greatest end. `read_indexed`
takes the rows that a region overlaps, deals them out and unpacks their blocks alone.

Cases: a file without records has no rows; records without a reference are runs with a null chrom and belong to no region;
files of other lengths than when they were indexed must be indexed anew; a file that is cut off is an error.
"""

from __future__ import annotations

import contextlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .alignments import READ_DDL, READ_KINDS, READ_NAMES, Bgzf, bam_header, bam_record, sample_of

INDEX_DDL = "path string, sample string, split int, start bigint, stop bigint, chrom string, low int, high int, reads bigint"
_CONSUMES = [True, False, True, True, False, False, False, True, True]  # of M I D N S H P = X, the reference
_MAGIC = b"\x1f\x8b\x08\x04"


def opened_at(uri: str):
    """A file that can be read at any place, in whichever file system its URI names."""
    fs, path = pa.fs.FileSystem.from_uri(uri) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def _block_size(raw: bytes) -> int | None:
    """The size of the block that raw begins with, if it does."""
    if len(raw) < 18 or raw[:4] != _MAGIC:
        return None
    extra, at = struct.unpack("<H", raw[10:12])[0], 12
    while at + 6 <= min(12 + extra, len(raw)):
        name, size = raw[at : at + 2], struct.unpack("<H", raw[at + 2 : at + 4])[0]
        if name == b"BC" and size == 2:
            return struct.unpack("<H", raw[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return None


def _unpacked(raw: bytes) -> bytes:
    block = zlib.decompressobj(31)
    out = block.decompress(raw)
    if not block.eof:
        raise ValueError("a BGZF block is cut off")
    return out


class Walk:
    """The unpacked bytes from a block on, with the virtual offset of each place."""

    def __init__(self, file, block: int) -> None:
        self.file, self.size, self.next = file, file.size(), block
        self.data, self.base = bytearray(), 0
        self.marks: list[tuple[int, int]] = []

    def more(self) -> bool:
        """Whether there was one more block to unpack."""
        if self.next >= self.size:
            return False
        raw = self.file.read_at(min(1 << 16, self.size - self.next), self.next)
        size = _block_size(raw)
        if size is None or size > len(raw):
            raise ValueError("a BGZF block is cut off")
        self.marks.append((self.base + len(self.data), self.next))
        self.data += _unpacked(raw[:size])
        self.next += size
        return True

    def has(self, at: int, n: int) -> bool:
        while self.base + len(self.data) < at + n:
            if not self.more():
                return False
        return True

    def bytes(self, at: int, n: int) -> bytes:
        if not self.has(at, n):
            raise ValueError("the BAM stream is cut off")
        return bytes(self.data[at - self.base : at - self.base + n])

    def offset(self, at: int) -> int:
        """The virtual offset of a place, or of the file's end."""
        if not self.has(at, 1):
            return self.size << 16
        begin, block = next(m for m in reversed(self.marks) if m[0] <= at)
        return block << 16 | at - begin

    def forget(self, at: int) -> None:
        """Let go of what lies before a place."""
        if at - self.base > 1 << 20:
            del self.data[: at - self.base]
            self.base = at
            held = next(i for i in range(len(self.marks) - 1, -1, -1) if self.marks[i][0] <= at)
            self.marks = self.marks[held:]

    def records(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(place, body) of the records from a place on."""
        while self.has(at, 1):
            size = struct.unpack("<i", self.bytes(at, 4))[0]
            yield at, self.bytes(at + 4, size)
            at += 4 + size
            self.forget(at)


def _looks_like(walk: Walk, at: int, references: int, followers: int = 8) -> bool:
    """Whether a record and its followers seem to begin at a place."""
    for _ in range(followers):
        if not walk.has(at, 36):
            return not walk.has(at, 1)
        size, ref, pos, name, _, _, ops, _, seq, other, other_pos = struct.unpack("<iiiBBHHHiii", walk.bytes(at, 32))
        if not (-1 <= ref < references and -1 <= other < references and pos >= -1 and other_pos >= -1 and name >= 1 and seq >= 0):
            return False
        if not 32 + name + 4 * ops + (seq + 1) // 2 + seq <= size <= 1 << 28:
            return False
        if not walk.has(at + 36, name) or walk.bytes(at + 35 + name, 1) != b"\0":
            return False
        at += 4 + size
    return True


def _first_block(file, begin: int, end: int) -> int | None:
    """The first place in begin..end where blocks begin one after another."""
    size, at = file.size(), begin
    while at < min(end, size):
        raw = file.read_at(min(1 << 18, size - at), at)
        found = raw.find(_MAGIC)
        while found >= 0 and at + found < end:
            n = _block_size(raw[found : found + 512])
            if n and (at + found + n == size or _block_size(file.read_at(min(512, max(0, size - at - found - n)), at + found + n))):
                with contextlib.suppress(ValueError, zlib.error):
                    _unpacked(file.read_at(n, at + found))
                    return at + found
            found = raw.find(_MAGIC, found + 1)
        at += max(1, len(raw) - len(_MAGIC))
    return None


def _guess(file, begin: int, end: int, references: int) -> int | None:
    """The virtual offset at which the first record of a split seems to begin."""
    block = _first_block(file, begin, end)
    while block is not None and block < end:
        walk = Walk(file, block)
        walk.more()
        stop, n = walk.next, len(walk.data)
        for u in range(n):
            if _looks_like(walk, u, references):
                return block << 16 | u
        block = stop if stop < file.size() else None
    return None


def _header(file) -> tuple[list[tuple[str, int]], int]:
    """The references, and the virtual offset of the first record."""
    walk = Walk(file, 0)

    class Reader(Bgzf):
        at = 0

        def read(self, n: int) -> bytes:
            got = walk.bytes(self.at, n) if n and walk.has(self.at, n) else b""
            self.at += len(got)
            return got

    reader = Reader(None)
    return bam_header(reader), walk.offset(reader.at)


def _walked(file, start: int, end: int, references: list[tuple[str, int]], run: int) -> list[tuple]:
    """Rows (start, stop, chrom, low, high, reads) of the records from a virtual offset that begin before byte `end` of the file."""
    walk, rows, held = Walk(file, start >> 16), [], None
    walk.more()
    for at, body in walk.records(start & 0xFFFF):
        place = walk.offset(at)
        if place >> 16 >= end:
            break
        ref, pos, name, _, _, ops = struct.unpack("<iiBBHH", body[:14])
        reach = pos + max(1, sum(v >> 4 for v in struct.unpack(f"<{ops}I", body[32 + name : 32 + name + 4 * ops]) if _CONSUMES[v & 15]))
        if held is None or held[2] != ref or held[5] >= run:
            if held:
                rows.append((held[0], place, *held[2:]))
            held = [place, None, ref, pos, reach, 0]
        held[3], held[4], held[5] = min(held[3], pos), max(held[4], reach), held[5] + 1
    else:
        place = walk.size << 16
    if held:
        rows.append((held[0], place, *held[2:]))
    return [(a, b, references[r][0] if r >= 0 else None, low, high, n) for a, b, r, low, high, n in rows]


def _indexer(split_bytes: int, run: int):
    names, kinds = ["path", "sample", "split", "start", "stop", "chrom", "low", "high", "reads"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sample, split, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened_at(path) as file:
                    references, first = _header(file)
                    end = (split + 1) * split_bytes
                    if known is not None:
                        start = known
                    elif first >> 16 >= split * split_bytes:  # there are no records before
                        start = first
                    else:
                        start = _guess(file, split * split_bytes, end, len(references))
                    rows = _walked(file, start, end, references, run) if start is not None and start >> 16 < end else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((path, sample, split, *r) for r in rows), strict=True), kinds, strict=True)], names=names)

    return indexed


def _mismatched(index: DataFrame, files: DataFrame) -> DataFrame:
    """path, sample, split and known: the first split of each file that has to be walked from elsewhere, and from where."""
    ends = index.groupBy("path", "sample", "split").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    order = Window.partitionBy("path").orderBy("split")
    after = ends.join(files.select("path", "length"), "path").withColumn("next", F.coalesce(F.lead("start").over(order), F.shiftleft("length", 16)))
    wrong = after.withColumn("then", F.coalesce(F.lead("split").over(order), F.col("split") + 1)).filter("next <> stop")
    return wrong.groupBy("path", "sample").agg(F.min_by(F.struct(F.col("then").alias("split"), F.col("stop").alias("known")), "split").alias("s")).select("path", "sample", "s.split", "s.known")


def index_bam(spark: SparkSession, paths: str | list[str], folder: str, split_bytes: int = 64 << 20, run: int = 20_000) -> DataFrame:
    """The index of BAM files, written to `folder`: INDEX_DDL, a row for at most `run` records; split by split."""
    files = spark.read.format("binaryFile").load(paths).select("path", sample_of(F.col("path")).alias("sample"), "length")
    splits = files.select("path", "sample", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / split_bytes)).cast("int"))).alias("split"))
    n = max(1, splits.count())
    todo = splits.withColumn("nth", F.row_number().over(Window.orderBy("path", "split")) - 1).repartitionById(n, F.col("nth").cast("int")).select("path", "sample", "split", F.lit(None).cast("long").alias("known"))
    made, nth = None, 0
    while True:
        found = todo.mapInArrow(_indexer(split_bytes, run), INDEX_DDL)
        kept = found if made is None else made.join(F.broadcast(todo.select("path", "split")), ["path", "split"], "left_anti").select(*found.columns).union(found)
        kept.write.mode("overwrite").parquet(f"{folder}/walk={nth}")
        made = spark.read.schema(INDEX_DDL).parquet(f"{folder}/walk={nth}")
        # a split that is walked anew may end elsewhere, so one split a file is, and its followers are looked at again
        todo = _mismatched(made, files)
        if not todo.limit(1).count():
            return made
        nth += 1


def read_indexed(index: DataFrame, chrom: str | None = None, start: int = 0, end: int | None = None, tasks: int | None = None, rows: int = 5000) -> DataFrame:
    """Reads of indexed files, or those that overlap start..end of chrom; only the blocks of runs that do are read."""
    overlaps = index if chrom is None else index.filter((F.col("chrom") == chrom) & (F.col("high") > start) & (F.lit(True) if end is None else F.col("low") < end))
    n = tasks or max(1, min(overlaps.count(), 4096))
    dealt = overlaps.select("path", "sample", "start", "stop").repartitionByRange(n, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), READ_KINDS, strict=True)], names=READ_NAMES)

        known: dict[str, list[tuple[str, int]]] = {}
        for batch in batches:
            for path, sample, begin, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened_at(path) as file:
                    if path not in known:
                        known = {path: _header(file)[0]}
                    walk, block = Walk(file, begin >> 16), []
                    walk.more()
                    for at, body in walk.records(begin & 0xFFFF):
                        if walk.offset(at) >= stop:
                            break
                        ref, pos, name, _, _, ops = struct.unpack("<iiBBHH", body[:14])
                        if chrom is not None:
                            reach = pos + max(1, sum(v >> 4 for v in struct.unpack(f"<{ops}I", body[32 + name : 32 + name + 4 * ops]) if _CONSUMES[v & 15]))
                            if reach <= start or (end is not None and pos >= end):
                                continue
                        block.append((sample, *bam_record(body, known[path])))
                        if len(block) >= rows:
                            yield told(block)
                            block = []
                    if block:
                        yield told(block)

    return dealt.mapInArrow(read, READ_DDL)
