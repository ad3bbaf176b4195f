"""Pileups by position: counts, consensus, major and minor alleles, candidates, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqmill.functions import bases

from .calls import CallFilter, forward_calls

COUNTS = ["n_a", "n_c", "n_g", "n_t"]
SITE = ["chrom", "sample", "pos"]


def base_counts(base: Column) -> list[Column]:
    return [F.count_if(base == b).alias(c) for b, c in zip(bases.BASES, COUNTS, strict=True)]


def pileup(reads: DataFrame, min_bq: int = 20) -> DataFrame:
    """chrom, sample, pos and the counts of A, C, G, T: one shuffle, with partial counts before it."""
    calls = forward_calls(reads, CallFilter.for_pileup(min_bq))
    return calls.groupBy("chrom", "sample", F.col("refpos").alias("pos")).agg(*base_counts(F.col("base")))


def stranded_pileup(reads: DataFrame, min_bq: int = 20) -> DataFrame:
    """Counts by strand: f_a .. f_t of forward and r_a .. r_t of reverse reads."""
    calls = forward_calls(reads, CallFilter.for_pileup(min_bq))
    sums = [F.count_if((F.col("base") == b) & (F.col("is_reverse") == r)).alias(f"{s}_{b.lower()}") for r, s in ((False, "f"), (True, "r")) for b in bases.BASES]
    return calls.groupBy("chrom", "sample", F.col("refpos").alias("pos")).agg(*sums)


def merge_strands(stranded: DataFrame) -> DataFrame:
    """A stranded pileup as a plain one."""
    return stranded.select(*SITE, *((F.col(f"f_{b}") + F.col(f"r_{b}")).alias(f"n_{b}") for b in "acgt"))


def coverage() -> Column:
    return F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")


def consensus(min_coverage: int = 20) -> Column:
    """The most frequent base, of ties the first in order A, C, G, T; N below min_coverage."""
    most = F.greatest(*COUNTS)
    first = F.when(F.col("n_a") == most, "A").when(F.col("n_c") == most, "C").when(F.col("n_g") == most, "G").otherwise("T")
    return F.when(coverage() < max(min_coverage, 0), "N").otherwise(first)


def alleles() -> list[Column]:
    """major and minor: the two most frequent bases, of ties the later in order; N where the count is 0."""
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(c).alias("n"), F.lit(b).alias("base")) for b, c in zip(bases.BASES, COUNTS, strict=True)))))
    return [F.when(ranked[i]["n"] > 0, ranked[i]["base"]).otherwise("N").alias(name) for i, name in enumerate(("major", "minor"))]


def base_frequencies() -> list[Column]:
    """f_a .. f_t: counts over the coverage, 0 where there is none."""
    return [(F.col(c) / F.greatest(coverage(), F.lit(1))).alias("f" + c[1:]) for c in COUNTS]


def is_candidate(threshold: float) -> Column:
    """Whether more than one base is more frequent than threshold."""
    return sum((f > threshold).cast("int") for f in base_frequencies()) > 1


def with_contamination(sites: DataFrame, one: Column | None = None) -> DataFrame:
    """sites with contam_a .. contam_t: of the other samples with a consensus at the position, the
    fraction whose consensus is that base and differs from this sample's.

    All samples of a position are counted together and each one's own part is taken off, by a
    window over (chrom, pos): linear in samples, with no join of samples with each other.
    one: where a site has several rows, which of them counts.
    """
    place = Window.partitionBy("chrom", "pos")
    counted = F.lit(True) if one is None else one
    known = F.count_if(counted & (F.col("consensus") != "N")).over(place)
    others = F.greatest(known - (F.col("consensus") != "N").cast("long"), F.lit(1))
    counts = {b: F.count_if(counted & (F.col("consensus") == b)).over(place) for b in bases.BASES}
    fraction = lambda b: F.when((F.col("consensus") == "N") | (F.col("consensus") == b), 0.0).otherwise(counts[b] / others)
    return sites.select("*", *(fraction(b).alias(f"contam_{b.lower()}") for b in bases.BASES))


def sites(counts: DataFrame, min_coverage: int = 20, one: Column | None = None) -> DataFrame:
    """A pileup with consensus, alleles and contamination: the one table that calls are joined with."""
    return with_contamination(counts.select("*", consensus(min_coverage).alias("consensus"), *alleles()), one)


def dense(counts: DataFrame, contigs: DataFrame) -> DataFrame:
    """A pileup with every position of every (chrom, sample) of contigs (chrom, sample, length), zero-filled."""
    every = contigs.filter("length > 0").select("chrom", "sample", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("pos"))
    return every.join(counts, SITE, "left").na.fill(0, COUNTS)
