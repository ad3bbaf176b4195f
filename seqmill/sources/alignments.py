"""Alignment files as tables of reads: SAM text by Spark's own text reader, BAM streamed in tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READ_DDL = "sample string, chrom string, pos int, flag int, mapq int, cigar string, seq string, qual array<int>"
_CIGAR = "MIDNSHP=X"
_NIBBLES = "=ACMGRSVTWYHKDBN"


def sample_of(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of SAM files; text files are split, so one large file is read by many tasks."""
    lines = spark.read.text(paths).select(F.col("value"), sample_of(F.input_file_name()).alias("sample")).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t", 12)
    qual = F.when(f[10] == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split(f[10], ""), lambda c: F.ascii(c) - 33))
    return lines.select("sample", f[2].alias("chrom"), (f[3].cast("int") - 1).alias("pos"), f[1].cast("int").alias("flag"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), qual.alias("qual"))


def sam_contigs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sample, chrom, length from the @SQ header lines."""
    lines = spark.read.text(paths).select(F.col("value"), sample_of(F.input_file_name()).alias("sample")).filter(F.col("value").startswith("@SQ"))
    return lines.select("sample", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("int").alias("length"))


class Bgzf:
    """The uncompressed bytes of a BGZF stream, a block at a time."""

    def __init__(self, source) -> None:
        self.source, self.raw, self.data = source, b"", bytearray()

    def read(self, n: int) -> bytes:
        while len(self.data) < n:
            while len(self.raw) < 1 << 16:
                got = self.source.read(1 << 18)
                if not got:
                    break
                self.raw += got
            if not self.raw:
                break
            block = zlib.decompressobj(31)
            self.data += block.decompress(self.raw)
            if not block.eof:
                raise ValueError("a BGZF block is cut off")
            self.raw = block.unused_data
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def need(self, n: int) -> bytes:
        out = self.read(n)
        if len(out) < n:
            raise ValueError("the BAM stream is cut off")
        return out


def bam_header(stream: Bgzf) -> list[tuple[str, int]]:
    """(name, length) of the references."""
    if stream.need(4) != b"BAM\1":
        raise ValueError("not a BAM stream")
    stream.need(struct.unpack("<i", stream.need(4))[0])
    found = []
    for _ in range(struct.unpack("<i", stream.need(4))[0]):
        name = stream.need(struct.unpack("<i", stream.need(4))[0])[:-1].decode()
        found.append((name, struct.unpack("<i", stream.need(4))[0]))
    return found


def bam_record(body: bytes, references: list[tuple[str, int]]) -> tuple:
    """(chrom, pos, flag, mapq, cigar, seq, qual) of a record without its length."""
    ref, pos, name_size, mapq, _, ops, flag, size = struct.unpack("<iiBBHHHi", body[:20])
    at = 32 + name_size
    cigar = "".join(f"{v >> 4}{_CIGAR[v & 15]}" for v in struct.unpack(f"<{ops}I", body[at : at + 4 * ops])) or "*"
    at += 4 * ops
    packed = body[at : at + (size + 1) // 2]
    seq = "".join(_NIBBLES[b >> 4] + _NIBBLES[b & 15] for b in packed)[:size]
    qual = body[at + len(packed) : at + len(packed) + size]
    return references[ref][0] if ref >= 0 else None, pos, flag, mapq, cigar, seq, [] if qual[:1] == b"\xff" else list(qual)


def bam_records(stream: Bgzf, references: list[tuple[str, int]]) -> Iterator[tuple]:
    """bam_record() of each record of a stream after its header."""
    while head := stream.read(4):
        yield bam_record(stream.need(struct.unpack("<i", head)[0]), references)


def _opened(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)
    return fs.open_input_stream(path)


def _bam_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and sample of the files; Spark lists them, their content is not read here."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), sample_of(F.col("path")).alias("sample"))
    # a task a file: dealt by number, as hashes of few paths would leave tasks without any
    n = max(1, len(paths) if isinstance(paths, list) else spark.sparkContext.defaultParallelism)
    numbered = files.withColumn("nth", F.pmod(F.row_number().over(Window.orderBy("path")), F.lit(n)).cast("int"))
    return numbered.repartitionById(n, F.col("nth")).drop("nth")


READ_NAMES = ["sample", "chrom", "pos", "flag", "mapq", "cigar", "seq", "qual"]
READ_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]


def read_bam(spark: SparkSession, paths: str | list[str], rows: int = 5000) -> DataFrame:
    """Reads of BAM files, each streamed by one task with `rows` of them in memory; bam_index reads one file in many tasks."""
    names, kinds = READ_NAMES, READ_KINDS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sample in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as source:
                    stream, block = Bgzf(source), []
                    for record in bam_records(stream, bam_header(stream)):
                        block.append((sample, *record))
                        if len(block) >= rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], names=names)
                            block = []
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], names=names)

    return _bam_files(spark, paths).mapInArrow(read, READ_DDL)


def bam_contigs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sample, chrom, length from the headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sample in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as source:
                    found = bam_header(Bgzf(source))
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(found)), pa.array([n for n, _ in found]), pa.array([s for _, s in found], pa.int32())], names=["sample", "chrom", "length"])

    return _bam_files(spark, paths).mapInArrow(read, "sample string, chrom string, length int")
