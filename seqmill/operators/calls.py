"""Aligned reads to base calls: the alignment walk, filters, contexts and distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.functions import bases

REVERSE, READ2 = 16, 128
#: Unmapped, secondary, failed and duplicate reads, which a pileup skips.
SKIPPED_FLAGS = 4 | 256 | 512 | 1024


@dataclass(frozen=True)
class CallFilter:
    """What a call must reach: base quality, mapping quality and no flag of skip_flags."""

    min_bq: int = 20
    min_mq: int = 20
    skip_flags: int = 0

    @staticmethod
    def for_pileup(min_bq: int = 20) -> CallFilter:
        """Base quality alone, of reads that a pileup takes."""
        return CallFilter(min_bq, 0, SKIPPED_FLAGS)


def _ops(cigar: Column) -> tuple[Column, Column]:
    """The sizes and the letters of an alignment's operations, as two arrays."""
    pattern = F.lit(r"([0-9]+)([MIDNSHP=X])")
    whole = F.regexp_extract(cigar, "^([0-9]+)M$", 1).try_cast("int")
    sizes = F.transform(F.regexp_extract_all(cigar, pattern, F.lit(1)), lambda n: n.cast("int"))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(sizes), F.when(whole.isNotNull(), F.array(F.lit("M"))).otherwise(F.regexp_extract_all(cigar, pattern, F.lit(2)))


def _starts(sizes: Column, letters: Column) -> Column:
    """Where each operation begins, and where the last one ends, as query * 2^32 + reference: one sum for both."""
    both, query, reference = ("M", "=", "X"), ("I", "S"), ("D", "N")
    step = lambda n, op: n.cast("long") * F.when(op.isin(*both), 2**32 + 1).when(op.isin(*query), 2**32).when(op.isin(*reference), 1).otherwise(0)
    nothing = F.array(F.lit(0).cast("long"))
    summed = F.aggregate(F.zip_with(sizes, letters, step), nothing, lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    one = (F.size(sizes) == 1) & (F.element_at(letters, 1) == "M")
    return F.when(one, F.array(F.lit(0).cast("long"), F.element_at(sizes, 1).cast("long") * (2**32 + 1))).otherwise(summed)


def _run(op: Column, at: Column, pos: Column) -> tuple[Column, Column, Column]:
    """Whether an operation is a run of matches, and where it begins in the query and on the reference."""
    return op.isin("M", "=", "X"), F.shiftright(at, 32).cast("int"), pos.cast("int") + at.bitwiseAND(2**32 - 1).cast("int")


def aligned_length(cigar: Column) -> Column:
    """Reference bases that the alignment spans."""
    return F.element_at(_starts(*_ops(cigar)), -1).bitwiseAND(2**32 - 1).cast("int")


def aligned_runs(cigar: Column, pos: Column) -> Column:
    """An array of (q, r, n): n bases from qpos q on match the reference from r on; gaps and clips are left out."""
    sizes, letters = _ops(cigar)
    zipped = F.arrays_zip(sizes.alias("n"), letters.alias("op"), _starts(sizes, letters).alias("at"))
    matched = F.filter(zipped, lambda o: o["op"].isin("M", "=", "X") & (o["n"] > 0))

    def run(o: Column) -> Column:
        _, q, r = _run(o["op"], o["at"], pos)
        return F.struct(q.alias("q"), r.alias("r"), o["n"].alias("n"))

    return F.transform(matched, run)


def aligned_pairs(cigar: Column, pos: Column) -> Column:
    """An array of (qpos, refpos) of matched bases."""
    pair = lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.struct((s["q"] + i).alias("qpos"), (s["r"] + i).alias("refpos")))
    return F.flatten(F.transform(aligned_runs(cigar, pos), pair))


def _exploded(reads: DataFrame, min_bq: int, sequenced: bool = False) -> DataFrame:
    """Calls of A, C, G or T of at least min_bq, as they are called, with alen of their read; sequenced: and its letters in sequencing order."""
    reverse = F.col("flag").bitwiseAND(REVERSE) > 0
    read_num = F.col("flag").bitwiseAND(READ2).cast("boolean").cast("int") + 1
    if sequenced:  # once a read, as contexts are cuts of it
        reads = reads.withColumn("sequenced", bases.sequenced(F.col("seq"), reverse))
    told = ["sequenced"] if sequenced else []
    own = ["sample", "chrom", "mapq", "flag", "seq", "qual", *told]
    sizes, letters = _ops(F.col("cigar"))
    # the walk is a step of its own for each read; then come its operations, a few a read, then their positions
    walked = reads.select(*own, "pos", reverse.alias("is_reverse"), read_num.alias("read_num"), sizes.alias("n"), letters.alias("op"))
    walked = walked.withColumn("at", _starts(F.col("n"), F.col("op")))
    walked = walked.withColumn("alen", F.element_at("at", -1).bitwiseAND(2**32 - 1).cast("int"))
    ops = walked.select(*own, "pos", "is_reverse", "read_num", "alen", F.explode(F.arrays_zip("n", "op", "at")).alias("o"))
    matches, q, r = _run(F.col("o.op"), F.col("o.at"), F.col("pos"))
    runs = ops.filter(matches & (F.col("o.n") > 0)).select(*own, "is_reverse", "read_num", "alen", q.alias("q"), r.alias("r"), F.col("o.n").alias("n"))
    calls = runs.select(*own, "is_reverse", "read_num", "alen", "q", "r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    calls = calls.withColumns({"qpos": F.col("q") + F.col("i"), "refpos": F.col("r") + F.col("i")})
    calls = calls.withColumn("bq", F.col("qual")[F.col("qpos")]).filter(F.col("bq") >= min_bq)
    calls = calls.withColumn("called", F.substring("seq", F.col("qpos") + 1, F.lit(1))).filter(F.col("called").isin(*bases.BASES))
    return calls.select("sample", "chrom", "refpos", "qpos", "is_reverse", "read_num", "mapq", "flag", "bq", "called", "alen", *told)


def _kept(keep: CallFilter) -> Column:
    return (F.col("mapq") >= keep.min_mq) & (F.col("flag").bitwiseAND(keep.skip_flags) == 0)


def forward_calls(reads: DataFrame, keep: CallFilter) -> DataFrame:
    """sample, chrom, refpos, is_reverse, bq and base of every call kept, base as on the forward strand."""
    return _exploded(reads.filter(_kept(keep)), keep.min_bq).select("sample", "chrom", "refpos", "is_reverse", "bq", F.col("called").alias("base"))


def _read_off() -> list[Column]:
    """base in sequencing order, and dend."""
    called = F.when(F.col("is_reverse"), bases.complement_base(F.col("called"))).otherwise(F.col("called"))
    return [called.alias("base"), bases.distance(F.col("qpos"), F.col("alen"), F.col("is_reverse")).alias("dend")]


def base_calls(reads: DataFrame, keep: CallFilter = CallFilter(), context_length: int | None = None) -> DataFrame:
    """sample, chrom, refpos, qpos, is_reverse, read_num, mapq, bq, base and dend of every call kept.

    Reads are filtered before they are exploded, calls right after. With context_length, also the
    context; calls without a whole context or with an N in it go. base is in sequencing order:
    complemented on reverse reads. Calls outside ACGT go on both strands.
    """
    calls = _exploded(reads.filter(_kept(keep)), keep.min_bq, context_length is not None)
    if context_length is not None:
        calls = calls.filter(bases.has_context(F.col("qpos"), F.col("alen"), F.col("is_reverse"), context_length))
        calls = calls.withColumn("context", bases.context_of(F.col("sequenced"), F.col("qpos"), F.col("is_reverse"), context_length)).filter(~F.col("context").contains("N"))
    columns = ["sample", "chrom", "refpos", "qpos", "is_reverse", "read_num", "mapq", "bq", *_read_off()]
    return calls.select(*columns, *(["context"] if context_length is not None else []))


def marked_calls(reads: DataFrame, keep: CallFilter, context_length: int) -> DataFrame:
    """What base_calls() gives of `keep` and of a pileup at its base quality, with one explode: each call once, with
    observed and piled, which say of which of the two it is. context is null where a call has no whole one."""
    piled = F.coalesce(F.col("flag").bitwiseAND(SKIPPED_FLAGS) == 0, F.lit(False)) & F.coalesce(F.col("mapq") >= 0, F.lit(False))
    kept = F.coalesce(_kept(keep), F.lit(False))
    calls = _exploded(reads.filter(piled | kept), keep.min_bq, True)
    context = bases.context_of(F.col("sequenced"), F.col("qpos"), F.col("is_reverse"), context_length)
    calls = calls.withColumn("context", F.when(bases.has_context(F.col("qpos"), F.col("alen"), F.col("is_reverse"), context_length), context))
    observed = kept & F.coalesce(~F.col("context").contains("N"), F.lit(False))
    return calls.select("sample", "chrom", "refpos", "qpos", "is_reverse", "read_num", "mapq", "bq", *_read_off(), "context", piled.alias("piled"), observed.alias("observed"))


def in_region(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Reads that overlap [start, end) of a reference."""
    return reads.filter((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("pos") + aligned_length(F.col("cigar")) > start))


def with_bins(reads: DataFrame, width: int = 500) -> DataFrame:
    """Each read once for each bin of `width` bases that it overlaps: the clustering key of region work."""
    last = F.col("pos") + F.greatest(aligned_length(F.col("cigar")), F.lit(1)) - 1
    return reads.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / width).cast("int"), F.floor(last / width).cast("int"))))
