"""Hand-made reads: alignment walk, contexts at the ends, ties, contamination."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqmill.functions import bases
from seqmill.operators import observations, pileup
from seqmill.operators.calls import CallFilter, aligned_length, aligned_pairs, base_calls
from seqmill.sources.derived_reads import varied_reads

READ = "sample string, chrom string, pos int, flag int, mapq int, cigar string, seq string, qual array<int>"
ALL = CallFilter(0, 0)


def reads(spark, *rows):
    return spark.createDataFrame([("s0", "c", p, f, m, c, s, q or [30] * len(s)) for p, f, m, c, s, q in rows], READ)


@pytest.mark.parametrize(
    ("cigar", "pairs", "length"),
    [
        ("5S3M", [(5, 10), (6, 11), (7, 12)], 3),
        ("2M2I1M", [(0, 10), (1, 11), (4, 12)], 3),
        ("2M2D1M", [(0, 10), (1, 11), (2, 14)], 5),
        ("1M10N1M", [(0, 10), (1, 21)], 12),
        ("1H1=1X2P1M", [(0, 10), (1, 11), (2, 12)], 3),
        ("*", [], 0),
    ],
)
def test_alignment_walk(spark, cigar, pairs, length):
    row = spark.range(1).select(aligned_pairs(F.lit(cigar), F.lit(10)).alias("p"), aligned_length(F.lit(cigar)).alias("n")).first()
    assert [tuple(x) for x in row.p] == pairs
    assert row.n == length


def test_contexts_at_the_ends(spark):
    got = base_calls(reads(spark, (0, 0, 60, "5M", "ACGTA", None), (0, 16, 60, "5M", "ACGTA", None)), ALL, 2).orderBy("is_reverse", "qpos").collect()
    assert [(r.qpos, r.context, r.base, r.dend) for r in got if not r.is_reverse] == [(2, "AC", "G", 2), (3, "CG", "T", 3), (4, "GT", "A", 4)]
    # reverse: the complements of the two bases to the right, read backwards; distance from the aligned end
    assert [(r.qpos, r.context, r.base, r.dend) for r in got if r.is_reverse] == [(0, "CG", "T", 5), (1, "AC", "G", 4), (2, "TA", "C", 3)]


def test_filters(spark):
    rows = reads(spark, (0, 0, 19, "2M", "AC", None), (0, 0, 20, "3M", "ANC", [20, 20, 19]), (0, 1024, 60, "1M", "G", None))
    assert [(r.base, r.mapq) for r in base_calls(rows, CallFilter(20, 20)).orderBy("mapq").collect()] == [("A", 20), ("G", 60)]
    assert base_calls(rows, CallFilter.for_pileup(0)).count() == 4  # no duplicate, no N
    assert base_calls(reads(spark, (0, 0, 60, "4M", "ANGT", None)), ALL, 1).count() == 1  # an N in a context drops the call


def test_complement(spark):
    row = spark.range(1).select(bases.complement(F.lit("ACGTN")).alias("a"), bases.complement_base(F.lit("x")).alias("b"), bases.base_index(F.lit("N")).alias("i")).first()
    assert (row.a, row.b, row.i) == ("TGCAN", "N", -1)
    with pytest.raises(PySparkException):
        spark.range(1).select(bases.complement(F.lit("AXG"))).collect()


def test_rounding_is_half_up(spark):
    got = spark.range(16).select(bases.rounded(F.col("id"), 10).alias("r")).collect()
    assert [r.r for r in got] == [0] * 5 + [10] * 10 + [20]


@pytest.mark.parametrize(
    ("counts", "consensus", "major", "minor"),
    [((5, 5, 0, 0), "A", "C", "A"), ((0, 0, 0, 0), "N", "N", "N"), ((3, 0, 0, 0), "A", "A", "N"), ((2, 2, 2, 2), "A", "T", "G")],
)
def test_ties(spark, counts, consensus, major, minor):
    table = spark.createDataFrame([("c", "s", 0, *counts)], "chrom string, sample string, pos int, n_a long, n_c long, n_g long, n_t long")
    row = table.select(pileup.consensus(1).alias("c"), *pileup.alleles()).first()
    assert (row.c, row.major, row.minor) == (consensus, major, minor)


def test_contamination(spark):
    table = spark.createDataFrame([("c", s, 0, b) for s, b in (("s0", "A"), ("s1", "C"), ("s2", "A"), ("s3", "N"))], "chrom string, sample string, pos int, consensus string")
    got = {r.sample: (r.contam_a, r.contam_c, r.contam_g, r.contam_t) for r in pileup.with_contamination(table).collect()}
    assert got == {"s0": (0, 0.5, 0, 0), "s1": (1, 0, 0, 0), "s2": (0, 0.5, 0, 0), "s3": (0, 0, 0, 0)}


def test_covariate_names_and_width():
    c = observations.Covariates(("s0", "s1"), context_length=1, user=("depth",))
    assert c.names == ["const", "bq", "mq", "dend", "contamA", "contamC", "contamG", "contamT", "pC", "pG", "pT", "depth", "s1"]
    assert len(observations.Covariates(("s0",), context_length=0).names) == 8


def test_constant_columns_and_scaling(spark):
    rows = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 0, 4)], "a int, b int, z int, v int")
    stats = observations.column_statistics(rows, rows.columns)
    assert sorted(r.name for r in observations.variable_columns(stats).collect()) == ["a", "v"]
    scaled = observations.normalise(rows, {r["name"]: (r.low, r.high) for r in stats.collect()})
    assert [tuple(r) for r in scaled.orderBy("v").collect()] == [(0, 0, 0, 0), (0, 0, 0, 1)]


def test_partitions_do_not_matter(spark):
    from seqmill.sources.derived_reads import reads_of

    one = reads_of(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, pileup.sites(pileup.pileup(x)).collect())) for x in (one.coalesce(1), one.repartition(7)))
    assert a == b


@pytest.mark.parametrize("covariates", [observations.Covariates(("s0", "s1", "s2")), observations.Covariates(("s0", "s1", "s2"), context_length=0, use_bq=False, use_mq=False, use_distance=False, use_sample=False)])
@pytest.mark.parametrize("coverage", [0, 20])
def test_one_explode_equals_pileup_and_join(spark, covariates, coverage):
    whole = varied_reads(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    # a read without a sample or a quality, and a position that only reads which a pileup skips have
    odd = whole.limit(4).withColumn("sample", F.lit(None).cast("string")).union(whole.limit(3).withColumn("mapq", F.lit(None).cast("int")))
    rows = whole.union(odd).union(whole.limit(5).withColumns({"pos": F.lit(9000), "flag": F.lit(1024), "mapq": F.lit(60)}))
    calls = observations.observed_calls(rows, pileup.sites(pileup.pileup(rows), coverage), covariates)
    known = observations.collapse(calls, covariates)
    got = observations.collapsed_reads(rows, covariates, min_coverage=coverage)
    assert got.columns == known.columns and got.dtypes == known.dtypes
    assert known.count() > 100 and got.exceptAll(known).count() == 0 and known.exceptAll(got).count() == 0
    assert observations.collapsed_reads(rows.limit(0), covariates).count() == 0
