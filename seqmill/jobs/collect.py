"""Job: alignment files to sites and collapsed observations."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.jobs.model import ranges_of, varying
from seqmill.operators import observations, pileup
from seqmill.operators.calls import CallFilter
from seqmill.sources import alignments, bam_index, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("alignments", help="file with one SAM or BAM path a line")
    p.add_argument("references", help="comma-separated names, or a file of them")
    p.add_argument("output", help="folder for sites and observations")
    p.add_argument("--min-bq", type=tables.not_negative, default=20)
    p.add_argument("--min-mq", type=tables.not_negative, default=20)
    p.add_argument("--sample-data", help="CSV by sample of further covariates")
    p.add_argument("--context-length", type=tables.not_negative, default=2)
    p.add_argument("--round-distance-by", type=tables.positive, default=10)
    p.add_argument("--no-mapq", action="store_true")
    p.add_argument("--no-sample", action="store_true")
    p.add_argument("--keep-constant", action="store_true", help="keep covariates that do not vary")
    p.add_argument("--index", help="folder for an index of the BAM files, which are then read by many tasks and by the references asked for")
    p.add_argument("--counts", help="folder of count tables SAMPLE.CHROM.bqMIN_BQ.counts, which are taken for the pileup where they are there")
    p.add_argument("--append", action="store_true", help="add to the output; an error if it has a locus of these samples already")
    p.add_argument("--min-coverage", type=tables.not_negative, default=20)
    return p


def read_alignments(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of SAM and BAM files, which the list may mix."""
    kinds = [([p for p in paths if p.endswith(".bam")], alignments.read_bam, alignments.bam_contigs), ([p for p in paths if not p.endswith(".bam")], alignments.read_sam, alignments.sam_contigs)]
    found = [(read(spark, some), contigs(spark, some)) for some, read, contigs in kinds if some]
    return reduce(DataFrame.unionByName, [r for r, _ in found]), reduce(DataFrame.unionByName, [c for _, c in found])


def covariate_table(collected: DataFrame, covariates: observations.Covariates, keep_constant: bool) -> DataFrame:
    """i, name, low, high and kept of each covariate; constant ones are not kept, but for the first that is 1."""
    ranges = ranges_of(collected.withColumn("x", covariates.vector()), len(covariates.names))
    kept = covariates.names if keep_constant else varying(covariates.names, ranges)
    rows = [(i, n, None if low is None else float(low), None if high is None else float(high), n in kept) for i, (n, (low, high)) in enumerate(zip(covariates.names, ranges, strict=True))]
    return collected.sparkSession.createDataFrame(rows, "i int, name string, low double, high double, kept boolean")


def counted(spark: SparkSession, reads: DataFrame, folder: str | None, samples: tuple[str, ...], chroms: list[str], min_bq: int) -> DataFrame:
    """The pileup of reads; of a sample and reference with a table of counts in `folder`, made at the same threshold, that table's."""
    table, found = tables.kept_counts(spark, folder, list(samples), chroms, min_bq) if folder else (None, [])
    if table is None:
        return pileup.pileup(reads, min_bq)
    covered = F.struct("chrom", "sample").isin([F.struct(F.lit(c), F.lit(s)) for c, s in found])
    return pileup.merge_strands(table).filter(pileup.coverage() > 0).unionByName(pileup.pileup(reads.filter(~covered), min_bq))


def collect(reads: DataFrame, covariates: observations.Covariates, keep: CallFilter, min_coverage: int) -> tuple[DataFrame, DataFrame]:
    """(sites, observations) of reads."""
    return pileup.sites(pileup.pileup(reads, keep.min_bq), min_coverage), observations.collapsed_reads(reads, covariates, keep, min_coverage)


def main(spark: SparkSession, args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    paths = tables.alignment_paths(spark, a.alignments)
    reads, contigs = read_alignments(spark, paths)
    wanted = tables.reference_names(spark, a.references, contigs)
    bams = [p for p in paths if p.endswith(".bam")]
    if a.index and bams:
        index = bam_index.index_bam(spark, bams, a.index)
        reads = bam_index.read_indexed(index.filter(index.chrom.isin(wanted)))
        if len(bams) < len(paths):
            reads = reads.unionByName(alignments.read_sam(spark, [p for p in paths if not p.endswith(".bam")]))
    reads = reads.filter(reads.chrom.isin(wanted))
    samples = tuple(p.rpartition("/")[2].rpartition(".")[0] for p in paths)
    covariates = observations.Covariates(samples, a.context_length, a.round_distance_by, use_mq=not a.no_mapq, use_sample=not a.no_sample)
    sites = pileup.sites(counted(spark, reads, a.counts, samples, wanted, a.min_bq), a.min_coverage)
    if a.append:
        tables.add_sites(sites, f"{a.output}/sites", pileup.SITE)
    else:
        tables.write_sites(sites, f"{a.output}/sites")
    written = spark.read.parquet(f"{a.output}/sites")
    calls = observations.observed_calls(reads, written, covariates, CallFilter(a.min_bq, a.min_mq))
    if a.sample_data:
        extra = spark.read.option("header", True).option("inferSchema", True).csv(a.sample_data)
        user = tuple(c for c in extra.columns if c != "sample")
        covariates = observations.Covariates(samples, a.context_length, a.round_distance_by, use_mq=not a.no_mapq, use_sample=not a.no_sample, user=user)
        calls = observations.with_user_columns(calls, extra, user)
    rows = observations.collapse(calls, covariates)
    if a.append:
        tables.add_sites(rows, f"{a.output}/observations", [c for c in rows.columns if c not in pileup.COUNTS])
    else:
        tables.write_sites(rows, f"{a.output}/observations")
    spark.createDataFrame(list(enumerate(samples)), "i int, sample string").coalesce(1).write.mode("overwrite").parquet(f"{a.output}/samples")
    collected = spark.read.parquet(f"{a.output}/observations")
    covariate_table(collected, covariates, a.keep_constant).coalesce(1).write.mode("overwrite").parquet(f"{a.output}/covariates")


if __name__ == "__main__":
    main(SparkSession.builder.appName("collect").getOrCreate())
