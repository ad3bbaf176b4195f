"""Column functions on bases, contexts and distances along a read."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def complement(seq: Column) -> Column:
    """Each base complemented, order kept; letters outside ACGTN raise."""
    valid = seq.rlike("^[ACGTN]*$")
    return F.when(valid, F.translate(seq, "ACGTN", "TGCAN")).when(seq.isNotNull(), F.raise_error(F.concat(F.lit("not a base sequence: "), seq)))


def complement_base(base: Column) -> Column:
    """One base complemented; anything outside ACGT is N."""
    return F.when(base == "A", "T").when(base == "C", "G").when(base == "G", "C").when(base == "T", "A").when(base.isNotNull(), "N")


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T, else -1."""
    return (F.instr(F.lit(BASES), base) - 1).cast("int")


def context(seq: Column, qpos: Column, is_reverse: Column, k: int) -> Column:
    """The k bases sequenced before qpos (0-based): to its left, or the complement of those to its right, read backwards.

    Letters outside ACGT become N, so a context that holds one can be dropped or encoded as the
    baseline on either strand.
    """
    return context_of(sequenced(seq, is_reverse), qpos, is_reverse, k)


def sequenced(seq: Column, is_reverse: Column) -> Column:
    """A read's letters in sequencing order, letters outside ACGT as N: what context_of() cuts, made once a read."""
    clean = F.regexp_replace(seq, "[^ACGT]", "N")
    return F.when(is_reverse, F.translate(F.reverse(clean), "ACGT", "TGCA")).otherwise(clean)


def context_of(sequenced: Column, qpos: Column, is_reverse: Column, k: int) -> Column:
    """context() of a read's letters in sequencing order."""
    if k == 0:
        return F.lit("")
    right = F.length(sequenced) - qpos - 1  # bases sequenced before it, on a reverse read
    cut = F.substring(sequenced, F.greatest(right - k + 1, F.lit(1)), F.least(right, F.lit(k)))
    return F.when(is_reverse, cut).otherwise(F.substring(sequenced, qpos - k + 1, F.lit(k)))


def has_context(qpos: Column, alen: Column, is_reverse: Column, k: int) -> Column:
    """Whether k bases were sequenced before qpos; the end of a reverse read is its aligned length."""
    return F.when(is_reverse, qpos < alen - k).otherwise(qpos >= k)


def distance(qpos: Column, alen: Column, is_reverse: Column) -> Column:
    """Distance from the read's beginning: from 0 on forward, from 1 on reverse reads."""
    return F.when(is_reverse, alen - qpos).otherwise(qpos)


def rounded(d: Column, by: int) -> Column:
    """d rounded half up to a multiple of by."""
    return (F.floor((d + F.lit(by / 2)) / F.lit(float(by))) * by).cast("int")


def kmers(k: int) -> list[str]:
    """All k-mers in order but for the baseline, A repeated; none for k = 0."""
    return ["".join(p) for p in product(BASES, repeat=k)][1:]
