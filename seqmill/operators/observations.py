"""Covariates of base calls, and calls collapsed to counts of distinct covariates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqmill.functions import bases
from seqmill.sources.tables import stored

from .calls import CallFilter, base_calls, marked_calls
from .pileup import COUNTS, base_counts, coverage, sites

#: Sites up to which they are broadcast.
FEW = 100_000
CONTAM = ["contam_a", "contam_c", "contam_g", "contam_t"]


@dataclass(frozen=True)
class Covariates:
    """Which covariates there are. samples: the first is the baseline; user: names of columns of a
    table by sample that with_user_columns() adds."""

    samples: tuple[str, ...]
    context_length: int = 2
    round_distance_by: int = 10
    use_bq: bool = True
    use_mq: bool = True
    use_distance: bool = True
    use_contamination: bool = True
    use_sample: bool = True
    user: tuple[str, ...] = field(default=())

    @property
    def keys(self) -> list[str]:
        """The columns that tell covariates apart, before they are expanded into numbers."""
        used = [("bq", self.use_bq), ("mapq", self.use_mq), ("dend_bin", self.use_distance), ("context", self.context_length > 0)]
        return [c for c, on in used if on] + (CONTAM if self.use_contamination else []) + list(self.user) + (["sample"] if self.use_sample else [])

    @property
    def names(self) -> list[str]:
        used = [("const", True), ("bq", self.use_bq), ("mq", self.use_mq), ("dend", self.use_distance)]
        contam = [f"contam{b}" for b in bases.BASES] if self.use_contamination else []
        return [c for c, on in used if on] + contam + [f"p{k}" for k in bases.kmers(self.context_length)] + list(self.user) + (list(self.samples[1:]) if self.use_sample else [])

    def vector(self) -> Column:
        """All covariates as numbers, in the order of names."""
        parts: list[Column] = [F.lit(1.0)]
        parts += [F.col(c).cast("double") for c, on in (("bq", self.use_bq), ("mapq", self.use_mq), ("dend_bin", self.use_distance)) if on]
        parts += [F.col(c) for c in CONTAM] if self.use_contamination else []
        parts += [(F.col("context") == k).cast("double") for k in bases.kmers(self.context_length)]
        parts += [F.col(c).cast("double") for c in self.user]
        parts += [(F.col("sample") == s).cast("double") for s in self.samples[1:]] if self.use_sample else []
        if len(parts) != len(self.names):
            raise ValueError(f"{len(parts)} covariates, but {len(self.names)} names")
        return F.array(*parts)


def with_user_columns(calls: DataFrame, table: DataFrame, columns: tuple[str, ...], most: int = 100_000) -> DataFrame:
    """calls with columns of a table by sample; samples are counted first, then broadcast if they are at most `most`."""
    slim = table.select("sample", *columns)
    return calls.join(F.broadcast(slim) if slim.count() <= most else slim, "sample", "left")


def observed_calls(reads: DataFrame, site_table: DataFrame, covariates: Covariates, keep: CallFilter = CallFilter()) -> DataFrame:
    """Calls at sites with a consensus and a major allele, with all covariates of theirs.

    On reverse reads the contamination columns are those of the complementary bases. Sites are counted first and
    broadcast if they are few, so that deep ones need no shuffle of calls: give a table that is written.
    """
    calls = base_calls(reads, keep, covariates.context_length)
    calls = calls.withColumn("dend_bin", bases.rounded(F.col("dend"), covariates.round_distance_by)).withColumnRenamed("refpos", "pos")
    known = site_table.filter("consensus <> 'N' and major <> 'N'").select("chrom", "sample", "pos", "major", "minor", *CONTAM)
    joined = calls.join(F.broadcast(known) if site_table.count() <= FEW else known, ["chrom", "sample", "pos"])
    flipped = [F.when(F.col("is_reverse"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(CONTAM, reversed(CONTAM), strict=True)]
    return joined.select("chrom", "sample", "pos", "is_reverse", "read_num", "base", "bq", "mapq", "dend_bin", "context", *flipped, "major", "minor")


def collapse(calls: DataFrame, covariates: Covariates, site: tuple[str, ...] = ("chrom", "sample", "pos")) -> DataFrame:
    """One row for each site, strand, read number and distinct covariates, with base counts."""
    keys = list(dict.fromkeys([*site, "is_reverse", "read_num", *covariates.keys]))
    return calls.groupBy(*keys, "major", "minor").agg(*base_counts(F.col("base")))


def collapsed_reads(reads: DataFrame, covariates: Covariates, keep: CallFilter = CallFilter(), min_coverage: int = 20) -> DataFrame:
    """collapse() of the observed_calls() of reads at the sites of their own pileup, with one explode.

    Calls are counted by site, strand and covariates first, those of the pileup alone by site and strand. What a hot
    position holds is then one row for each of its distinct covariates. These rows are written; sites are summed from
    them, and joined with them, not with calls. Columns of a user's table are not of the reads: they need collapse().
    """
    return collapsed_counts(stored(counted_reads(reads, covariates, keep), "counted"), covariates, min_coverage)


def _own(covariates: Covariates) -> list[str]:
    return ["read_num", *(c for c in ("bq", "mapq", "dend_bin", "context") if c in covariates.keys)]


def counted_reads(reads: DataFrame, covariates: Covariates, keep: CallFilter = CallFilter()) -> DataFrame:
    """Counts of calls by site, strand and own covariates, those of the pileup beside them (piled_a .. piled_t): what
    collapsed_counts() and piled_counts() both read, so that it can be written once for the two."""
    calls = marked_calls(reads, keep, covariates.context_length).withColumn("dend_bin", bases.rounded(F.col("dend"), covariates.round_distance_by))
    told = [F.when(F.col("observed"), F.col(c)).alias(c) for c in _own(covariates)]
    piled = [F.count_if(F.col("piled") & (F.col("base") == b)).alias(f"piled_{b.lower()}") for b in bases.BASES]
    return calls.groupBy("chrom", "sample", F.col("refpos").alias("pos"), "is_reverse", "observed", *told).agg(*(c.alias(f"own_{n}") for c, n in zip(base_counts(F.col("base")), COUNTS, strict=True)), *piled)


def _forward() -> list[Column]:
    return [F.when(F.col("is_reverse"), F.col(f"piled_{b}")).otherwise(F.col(f"piled_{a}")) for a, b in zip("acgt", "tgca", strict=True)]


def piled_counts(counted: DataFrame) -> DataFrame:
    """The pileup of counted_reads()."""
    return counted.groupBy("chrom", "sample", "pos").agg(*(F.sum(c).alias(n) for c, n in zip(_forward(), COUNTS, strict=True))).filter(coverage() > 0)


def collapsed_counts(counted: DataFrame, covariates: Covariates, min_coverage: int = 20) -> DataFrame:
    """The collapsed_reads() of counted_reads(), which are read twice: give what is written."""
    table = stored(sites(piled_counts(counted), min_coverage), "sites")
    known = table.filter("consensus <> 'N' and major <> 'N'").select("chrom", "sample", "pos", "major", "minor", *CONTAM)
    rows = counted.filter("observed").join(F.broadcast(known) if table.count() <= FEW else known, ["chrom", "sample", "pos"])
    flipped = [F.when(F.col("is_reverse"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(CONTAM, reversed(CONTAM), strict=True)]
    told = rows.select("chrom", "sample", "pos", "is_reverse", *_own(covariates), *flipped, "major", "minor", *(F.col(f"own_{n}").alias(n) for n in COUNTS))
    keys = list(dict.fromkeys(["chrom", "sample", "pos", "is_reverse", "read_num", *covariates.keys]))
    return told.select(*keys, "major", "minor", *COUNTS)


def dictionary(observations: DataFrame, covariates: Covariates) -> DataFrame:
    """The distinct covariates of a whole data set, with their base counts."""
    return observations.groupBy(*covariates.keys).agg(*(F.sum(c).alias(c) for c in COUNTS))


def dictionary_of_calls(calls: DataFrame, covariates: Covariates) -> DataFrame:
    """As dictionary(), straight from calls: one aggregate, not one by site first."""
    return calls.groupBy(*covariates.keys).agg(*base_counts(F.col("base")))


def with_local_ids(observations: DataFrame, covariates: Covariates) -> DataFrame:
    """local_id: 0, 1, .. within a site, by strand, read number and covariates."""
    order = Window.partitionBy("chrom", "sample", "pos").orderBy("is_reverse", "read_num", *[c for c in covariates.keys if c != "sample"])
    return observations.withColumn("local_id", F.row_number().over(order) - 1)


def column_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, low, high, kinds of each column over the distinct rows: one aggregate, then a stack."""
    sums = [x for c in columns for x in (F.min(c).cast("double").alias(f"{c}__low"), F.max(c).cast("double").alias(f"{c}__high"), F.count_distinct(F.col(c)).alias(f"{c}__kinds"))]
    one = rows.agg(*sums)
    entries = [F.struct(F.lit(c).alias("name"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high"), F.col(f"{c}__kinds").alias("kinds")) for c in columns]
    return one.select(F.inline(F.array(*entries)))


def variable_columns(statistics: DataFrame) -> DataFrame:
    """Columns that vary, and of those that are constantly 1 the first by name; a row for each column, so few."""
    first = Window.orderBy("name")
    ones = statistics.filter("kinds = 1 and low = 1 and high = 1").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return statistics.filter("kinds > 1").union(ones)


def normalise(rows: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    """Each column scaled to 0..1 by its low and high; a constant one becomes 0."""
    scaled = {c: ((F.col(c) - low) / (high - low)) if high > low else F.lit(0.0) for c, (low, high) in statistics.items()}
    return rows.withColumns(scaled)


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with side: none if both sides cover the same sites."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))
