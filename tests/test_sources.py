"""Generated SAM, BAM and count files; the collect job; the growing pileup."""

from __future__ import annotations

import struct
import zlib

import pytest

from seqmill.jobs import collect
from seqmill.operators import pileup
from seqmill.sources import alignments, tables
from seqmill.sources.derived_reads import reads_of
from seqmill.streaming import pileup as streaming

READS = [("r1", 0, "c1", 3, 60, "4M", "ACGT", [30, 31, 32, 33]), ("r2", 16, "c1", 5, 40, "1S3M", "GACG", [20, 21, 22, 23]), ("r3", 128, "c2", 0, 50, "2M1D1M", "TTA", [40, 40, 40])]


def sam_text():
    lines = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:50", "@SQ\tSN:c2\tLN:20"]
    return "\n".join(lines + [f"{n}\t{f}\t{c}\t{p + 1}\t{m}\t{g}\t*\t0\t0\t{s}\t{''.join(chr(q + 33) for q in qs)}" for n, f, c, p, m, g, s, qs in READS]) + "\n"


def bgzf(data: bytes, piece: int = 70) -> bytes:
    out = b""
    for at in range(0, len(data), piece):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.compress(data[at : at + piece]) + c.flush()
    return out


def bam_bytes():
    refs = [("c1", 50), ("c2", 20)]
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for n, size in refs:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    for n, f, c, p, m, g, s, qs in READS:
        import re

        ops = [(int(k), "MIDNSHP=X".index(o)) for k, o in re.findall(r"(\d+)([A-Z=])", g)]
        codes = ["=ACMGRSVTWYHKDBN".index(x) for x in s] + [0] * (len(s) % 2)
        body = struct.pack("<iiBBHHHiiii", ["c1", "c2"].index(c), p, len(n) + 1, m, 0, len(ops), f, len(s), -1, -1, 0)
        body += n.encode() + b"\0" + b"".join(struct.pack("<I", k << 4 | o) for k, o in ops)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qs)
        data += struct.pack("<i", len(body)) + body
    return bgzf(data)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "one.sam").write_text(sam_text())
    (tmp_path / "one.bam").write_bytes(bam_bytes())
    return tmp_path


def test_sam_and_bam_hold_the_same_reads(spark, files):
    want = sorted(("one", c, p, f, m, g, s, q) for _, f, c, p, m, g, s, q in READS)
    for read, name in ((alignments.read_sam, "one.sam"), (alignments.read_bam, "one.bam")):
        assert sorted(tuple(r) for r in read(spark, f"{files}/{name}").collect()) == want
    for contigs, name in ((alignments.sam_contigs, "one.sam"), (alignments.bam_contigs, "one.bam")):
        assert sorted(map(tuple, contigs(spark, f"{files}/{name}").collect())) == [("one", "c1", 50), ("one", "c2", 20)]


def test_a_cut_bam_raises(spark, files):
    (files / "cut.bam").write_bytes(bam_bytes()[:-30])
    with pytest.raises(Exception, match="cut off"):
        alignments.read_bam(spark, f"{files}/cut.bam").collect()


def test_lists(spark, files):
    (files / "list").write_text(f"{files}/one.sam\n")
    assert tables.alignment_paths(spark, f"{files}/list") == [f"{files}/one.sam"]
    (files / "twice").write_text(f"{files}/one.sam\n{files}/one.sam\n")
    with pytest.raises(ValueError, match="twice"):
        tables.alignment_paths(spark, f"{files}/twice")
    contigs = alignments.sam_contigs(spark, f"{files}/one.sam")
    assert tables.reference_names(spark, "c1,c2", contigs) == ["c1", "c2"]
    with pytest.raises(ValueError, match="c9"):
        tables.reference_names(spark, "c1,c9", contigs)
    for bad in (lambda: tables.positive(0), lambda: tables.not_negative(-1), lambda: tables.probability(1.1)):
        with pytest.raises(ValueError):
            bad()


def test_counts_table(spark, tmp_path):
    (tmp_path / "x.counts").write_text("# made\nA\ta\tC\tc\tG\tg\tT\tt\n1\t2\t0\t0\t0\t0\t0\t0\n0\t0\t3\t1\t0\t0\t0\t5\n")
    got = pileup.merge_strands(tables.read_counts(spark, f"{tmp_path}/x.counts", "c1", "s")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("c1", "s", 0, 3, 0, 0, 0), ("c1", "s", 1, 0, 4, 0, 5)]


def test_collect_job(spark, files):
    (files / "list").write_text(f"{files}/one.sam\n")
    (files / "extra.csv").write_text("sample,depth\none,7\n")
    collect.main(spark, [f"{files}/list", "c1", f"{files}/out", "--min-coverage", "1", "--context-length", "1", "--sample-data", f"{files}/extra.csv"])
    sites, obs = (spark.read.parquet(f"{files}/out/{x}") for x in ("sites", "observations"))
    assert sites.count() == 5 and {r.depth for r in obs.collect()} == {7}
    assert tables.duplicate_keys(sites, ["chrom", "sample", "pos"]).count() == 0
    assert obs.selectExpr("sum(n_a + n_c + n_g + n_t)").first()[0] == 4  # three of the forward read; of the clipped reverse one, qpos 1 alone lies before its aligned end


def test_posterior_lines(spark, tmp_path):
    table = spark.createDataFrame([("s", "c", 4, 0.25, [-1.0, -0.5])], "sample string, chrom string, pos int, best_freq double, log_post array<double>")
    tables.write_posterior(table, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first().value == "s\tc\t4\t2.50000000e-01\t-1.00000000e+00\t-5.00000000e-01"


def test_growing_pileup(spark, tmp_path):
    reads = reads_of(spark, "/root/testdata/sf0.001").limit(500)
    reads.repartition(3).write.parquet(f"{tmp_path}/reads")
    query = streaming.growing_pileup(streaming.read_stream(spark, f"{tmp_path}/reads", 1)).writeStream.outputMode("complete").format("memory").queryName("grown").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = sorted(map(tuple, pileup.pileup(spark.read.parquet(f"{tmp_path}/reads")).collect()))
    assert sorted(map(tuple, spark.table("grown").collect())) == want
