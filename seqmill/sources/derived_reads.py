"""Aligned reads derived from lineitem rows by integer arithmetic: three samples, three references.

Reads are 12 bases long without gaps; about one call in 97 is an error, and sample s1 carries
another base at every 41st position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 12
SAMPLES = ("s0", "s1", "s2")


def _base(i: int) -> str:
    """The letter at place i of a read, in SQL."""
    p = f"(pos + {i})"
    return f"substr('ACGT', cast(1 + ({p}*{p}*3 + {p}*5 + case when (ok*31 + pk*17 + {i}*7 + ln) % 97 = 0 then 1 + ok % 3 when {p} % 41 = 0 and sample = 's1' then 2 else 0 end) % 4 as int), 1)"


def _letters(keys: DataFrame, n: int) -> DataFrame:
    """keys (sample, pos, ok, pk, ln, none of them negative) with seq, the n letters of _base(), and qual.

    The letters repeat every four positions, 7 i runs through all remainders of 97 and 5 i through those of 31. So a read is a
    cut of a fixed text with at most one error and one position of s1 laid over it, and the step's code stays
    below the size that the JVM compiles; the letters' formulas side by side are beyond it.
    """
    plain = ("AAGG" * (n // 4 + 2))[: n + 3]
    quality = F.lit([10 + 5 * j % 31 for j in range(31 + n)]).cast("array<int>")
    placed = keys.withColumns({
        "seq": F.expr(f"substr('{plain}', cast(1 + pos % 4 as int), {n})"),
        "marked": F.expr("case when sample = 's1' then (41 - pos % 41) % 41 end"),
        "wrong": F.expr("pmod((ok*31 + pk*17 + ln) % 97 * -14, 97)"),
        "qual": F.slice(quality, F.expr("cast(1 + (ok + ln*3) % 31 * 25 % 31 as int)"), n),
    })
    other = "substr('GGAA', cast(1 + (pos + marked) % 4 as int), 1)"
    p = "(pos + wrong)"
    error = f"substr('ACGT', cast(1 + ({p}*{p}*3 + {p}*5 + 1 + ok % 3) % 4 as int), 1)"
    marked = placed.withColumn("seq", F.expr(f"case when marked < {n} then overlay(seq, {other}, cast(marked + 1 as int), 1) else seq end"))
    return marked.withColumn("seq", F.expr(f"case when wrong < {n} then overlay(seq, {error}, cast(wrong + 1 as int), 1) else seq end"))


def derived_reads(lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """sample, chrom, pos, flag, mapq, cigar, seq, qual: one read for each row of lineitem.

    parts: deal the reads into as many tasks by what tells their calls apart, as files sorted by position hold them: calls
    of the same site and covariates then meet before they are shuffled, and what a task holds does not grow with the input.
    """
    keys = lineitem.selectExpr(
        "concat('s', cast(l_suppkey % 3 as string)) as sample", "concat('chr', l_returnflag) as chrom",
        "cast((l_partkey*7 + l_linenumber*3) % 400 as int) as pos", "l_orderkey as ok", "l_partkey as pk", "l_linenumber as ln",
        "cast(16 * (l_orderkey % 2) + 64 * (1 + l_linenumber % 2) as int) as flag", "cast(l_quantity as int) as mapq",
    )
    if parts is not None:
        keys = keys.repartition(parts, "sample", "chrom", F.floor(F.col("pos") / 40), "flag", "mapq")
    return _letters(keys, LENGTH).select("sample", "chrom", "pos", "flag", "mapq", F.lit(f"{LENGTH}M").alias("cigar"), "seq", "qual")


#: Alignments of the varied reads in turn, and their lengths.
CIGARS = ["12M", "5S7M", "3M2I7M", "4M2D8M", "3M10N9M", "2H16M", "6=2X4D5M3S", "1S3M1I2M3D5M"]
SIZES = [12, 12, 12, 12, 12, 16, 16, 12]


def varied_reads(lineitem: DataFrame) -> DataFrame:
    """As derived_reads(), with the alignments of CIGARS, an unknown base in every eleventh read, and reads that a pileup skips."""
    long = lineitem.selectExpr(
        "concat('s', cast(l_suppkey % 3 as string)) as sample", "concat('chr', l_returnflag) as chrom",
        "cast((l_partkey*7 + l_linenumber*3) % 400 as int) as pos", "l_orderkey as ok", "l_partkey as pk", "l_linenumber as ln",
        "cast(16 * (l_orderkey % 2) + 64 * (1 + l_linenumber % 2) + case when l_orderkey % 13 = 0 then 1024 when l_orderkey % 17 = 0 then 256 when l_orderkey % 19 = 0 then 512 else 0 end as int) as flag",
        "cast(l_quantity as int) as mapq", f"cast((l_orderkey + l_partkey) % {len(CIGARS)} as int) as kind",
    )
    kind = F.col("kind") + 1
    size = F.element_at(F.lit(SIZES).cast("array<int>"), kind)
    seq = F.expr("case when ok % 11 = 0 then overlay(seq, 'N', 7, 1) else seq end")
    cut = _letters(long, max(SIZES)).withColumn("size", size)
    return cut.select("sample", "chrom", "pos", "flag", "mapq", F.element_at(F.lit(CIGARS), kind).alias("cigar"), F.substring(seq, F.lit(1), F.col("size")).alias("seq"), F.slice("qual", F.lit(1), F.col("size")).alias("qual"))


#: Rows of lineitem a task: what a task holds does not grow with the input.
TASK_ROWS = 250_000


def _parts(table: DataFrame) -> int:
    """Tasks to deal a table into; its rows are counted by the files' own footers."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def spread(table: DataFrame) -> DataFrame:
    """A table of few files dealt anew by its keys, as one with a single row group is read by one task; one of many files as it is."""
    few = len(table.inputFiles()) < table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(_parts(table), "l_orderkey", "l_linenumber") if few else table


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def varied_reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_reads(spread(_lineitem(spark, sf_dir)))


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_reads(spread(_lineitem(spark, sf_dir)))


def placed_reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads_of(), dealt by where they lie: for steps that keep nearly every call apart within a task of any reads."""
    lineitem = _lineitem(spark, sf_dir)
    return derived_reads(lineitem, _parts(lineitem))
