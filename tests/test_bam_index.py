"""BAM files read in parts and by region, against the stream of the whole file."""

from __future__ import annotations

import random
import re
import struct
import zlib

import pytest

from seqmill.jobs import collect
from seqmill.sources import alignments, bam_index

REFS = [("c1", 5000), ("c2", 3000), ("c3", 100)]


def record(name, flag, ref, pos, mapq, cigar, seq, qual):
    ops = [(int(k), "MIDNSHP=X".index(o)) for k, o in re.findall(r"(\d+)([A-Z=])", cigar)]
    codes = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", k << 4 | o) for k, o in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual)
    return struct.pack("<i", len(body)) + body


def bgzf(data, rng):
    out, at = b"", 0
    while at < len(data):
        piece = data[at : at + rng.choice([1, 300, 700, 2500])]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(piece) + c.flush()
        out += struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(piece), len(piece))
        at += len(piece)
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("bam"), random.Random(3)
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\tx" + struct.pack("<i", len(REFS))
    for n, size in REFS:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    fake = b"".join(record("fake", 0, 0, 7, 60, "4M", "ACGT", [1, 2, 3, 4]) for _ in range(60))
    for name in ("one", "two"):
        rows = [(rng.randrange(2), rng.randrange(2900)) for _ in range(1500)]
        rows = sorted(rows) + [(-1, -1)] * 20
        parts = []
        for i, (ref, pos) in enumerate(rows):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 60)))
            cigar = f"{len(seq)}M" if i % 3 else f"1S{len(seq) - 1}M5D" if len(seq) > 1 else "1M"
            parts.append(record(f"r{i}", rng.choice([0, 16, 128]), ref, pos, rng.randrange(60), cigar if ref >= 0 else "", seq, [rng.randrange(41) for _ in seq]))
            if i % 500 == 250:  # qualities that read like records
                parts.append(record("long", 0, max(ref, 0), max(pos, 0), 9, f"{len(fake)}M", "A" * len(fake), fake))
        (out / f"{name}.bam").write_bytes(bgzf(head + b"".join(parts), rng))
    (out / "none.bam").write_bytes(bgzf(head, rng))
    return out


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("split", [2000, 5000, 1 << 20])
def test_one_file_by_many_tasks(spark, folder, tmp_path, split):
    paths = [f"{folder}/{n}.bam" for n in ("one", "two", "none")]
    index = bam_index.index_bam(spark, paths, str(tmp_path / "index"), split, run=100)
    reads = bam_index.read_indexed(index, tasks=8)
    assert rows_of(reads) == rows_of(alignments.read_bam(spark, paths))
    assert reads.rdd.getNumPartitions() == 8
    if split < 1 << 20:
        assert index.filter("sample = 'one'").select("split").distinct().count() >= 8
        assert (tmp_path / "index" / "walk=1").exists()  # guesses that the long qualities misled were mended
    assert index.agg({"reads": "sum"}).first()[0] == 2 * 1523


def test_a_region_reads_its_blocks_only(spark, folder, tmp_path):
    path = f"{folder}/one.bam"
    index = bam_index.index_bam(spark, path, str(tmp_path / "index"), 4000, run=50)
    whole = alignments.read_bam(spark, path).collect()
    reach = lambda r: r.pos + max(1, sum(int(n) for n, o in re.findall(r"(\d+)([MDN=X])", r.cigar)))
    for chrom, start, end in (("c1", 100, 160), ("c2", 2500, None), ("c3", 0, 100), ("c1", 0, 5000)):
        want = sorted(str(r) for r in whole if r.chrom == chrom and reach(r) > start and (end is None or r.pos < end))
        assert rows_of(bam_index.read_indexed(index, chrom, start, end)) == want
    asked = index.filter("chrom = 'c1' and high > 100 and low < 160").agg({"reads": "sum"}).first()[0]
    assert asked < 500  # 1523 records and a few long ones that reach far


def test_the_job_reads_by_index(spark, folder, tmp_path):
    (tmp_path / "list").write_text(f"{folder}/one.bam\n{folder}/two.bam\n")
    for more in ([], ["--index", f"{tmp_path}/index"]):
        collect.main(spark, [f"{tmp_path}/list", "c1,c2", f"{tmp_path}/out{len(more)}", "--min-coverage", "1", "--context-length", "1", *more])
    assert rows_of(spark.read.parquet(f"{tmp_path}/out0/observations")) == rows_of(spark.read.parquet(f"{tmp_path}/out2/observations"))


def test_a_cut_file_raises(spark, folder, tmp_path):
    (tmp_path / "cut.bam").write_bytes((folder / "one.bam").read_bytes()[:-600])
    with pytest.raises(Exception, match="cut off"):
        bam_index.index_bam(spark, str(tmp_path / "cut.bam"), str(tmp_path / "index"), 4000)
