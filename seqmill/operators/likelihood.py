"""Site likelihoods over the frequency grid, posteriors, most likely frequencies and the loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .pileup import COUNTS

SITE = ["chrom", "sample", "pos"]


def other_base(major: Column) -> Column:
    """The first base that is not major: the fixed stand-in for a minor allele that was never seen."""
    return F.when(major == "A", "C").otherwise("A")


def phred_error(bq: Column) -> Column:
    return F.pow(F.lit(10.0), -bq / 10.0)


def with_phred_probabilities(calls: DataFrame) -> DataFrame:
    """p_major and p_minor of calls (base, bq, major, minor): 1 - e for the allele itself, else e / 3."""
    e = phred_error(F.col("bq"))
    minor = F.when(F.col("minor") == "N", other_base(F.col("major"))).otherwise(F.col("minor"))
    p = lambda allele: F.when(F.col("base") == allele, 1 - e).otherwise(e / 3)
    return calls.withColumn("p_major", p(F.col("major"))).withColumn("p_minor", p(minor))


def grid_likelihood(calls: DataFrame, grid: DataFrame, weight: str = "n", most: int = 256) -> DataFrame:
    """SITE, k, f, lpf, loglik: the sum over calls of weight x log(f p_minor + (1 - f) p_major).

    The grid's rows, `most` at most, become one sum each in a single aggregate by site: calls are neither
    copied for each point nor joined, partial sums are shuffled, and what follows by site needs no
    further shuffle. For larger grids see packed_posterior().
    """
    points = grid.select("k", "f", "lpf").orderBy("k").limit(most + 1).collect()
    if len(points) > most:
        raise ValueError(f"a grid of over {most} points")
    p = lambda f: F.lit(f) * F.col("p_minor") + F.lit(1 - f) * F.col("p_major")
    sums = calls.groupBy(*SITE).agg(*(F.sum(F.col(weight) * F.log(p(r["f"]))).alias(f"sum_{i}") for i, r in enumerate(points)))
    each = [F.struct(F.lit(r["k"]).cast("int").alias("k"), F.lit(r["f"]).alias("f"), F.lit(r["lpf"]).alias("lpf"), F.col(f"sum_{i}").alias("loglik")) for i, r in enumerate(points)]
    return sums.select(*SITE, F.inline(F.array(*each)))


def posterior(likelihood: DataFrame) -> DataFrame:
    """SITE, k, f, log_joint and log_post, normalised within each site."""
    site = Window.partitionBy(*SITE)
    joint = likelihood.withColumn("log_joint", F.col("lpf") + F.col("loglik"))
    top = joint.withColumn("top", F.max("log_joint").over(site))
    total = F.col("top") + F.log(F.sum(F.exp(F.col("log_joint") - F.col("top"))).over(site))
    return top.select(*SITE, "k", "f", "log_joint", (F.col("log_joint") - total).alias("log_post"))


def most_likely(post: DataFrame) -> DataFrame:
    """SITE, best_k, best_freq, log_post of the most likely grid point, of ties the lowest."""
    best = F.max_by(F.struct("k", "f", "log_post"), F.struct("log_post", -F.col("k")))
    return post.groupBy(*SITE).agg(best.alias("b")).select(*SITE, F.col("b.k").alias("best_k"), F.col("b.f").alias("best_freq"), F.col("b.log_post").alias("log_post"))


def evidence(likelihood: DataFrame) -> DataFrame:
    """SITE and the log of its summed joint probabilities."""
    joint = likelihood.withColumn("log_joint", F.col("lpf") + F.col("loglik"))
    packed = joint.groupBy(*SITE).agg(F.collect_list("log_joint").alias("v"))
    top = F.array_max("v")
    return packed.select(*SITE, (top + F.log(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.exp(x - top)))).alias("evidence"))


def loss(likelihood: DataFrame) -> DataFrame:
    """One row: minus the mean evidence over sites, and how many sites there are."""
    return evidence(likelihood).agg((-F.avg("evidence")).alias("loss"), F.count("*").alias("sites"))


def packed_posterior(scored: DataFrame, f: np.ndarray, lpf: np.ndarray) -> DataFrame:
    """SITE, best_k, best_freq, log_post (an array) from rows with log-probabilities of the bases.

    scored: SITE, counts n_a .. n_t, and lp_major, lp_minor, arrays of four log-probabilities. The
    grid is a vector inside each Arrow batch, so no row is copied for each grid point; rows of a
    site meet in one shuffle as sums over the grid.
    """
    points = len(f)
    with np.errstate(divide="ignore"):
        log_f, log_1mf = np.log(f), np.log1p(-f)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            major, minor = (np.stack(frame[c].to_numpy())[:, None, :] for c in ("lp_major", "lp_minor"))
            terms = np.logaddexp(log_f[None, :, None] + minor, log_1mf[None, :, None] + major)
            total = (terms * frame[COUNTS].to_numpy(float)[:, None, :]).sum(2)
            codes, keys = pd.factorize(pd.MultiIndex.from_frame(frame[SITE]))
            sums = np.zeros((len(keys), points))
            np.add.at(sums, codes, total)
            out = pd.DataFrame(list(keys), columns=SITE)
            out["part"] = list(sums)
            yield out

    schema = StructType([*scored.select(*SITE).schema.fields, StructField("part", ArrayType(DoubleType()))])
    parts = scored.select(*SITE, *COUNTS, "lp_major", "lp_minor").mapInPandas(summed, schema)
    adds = parts.groupBy(*SITE).agg(F.array(*(F.sum(F.col("part")[i]) for i in range(points))).alias("loglik"))
    joint = F.zip_with("loglik", F.array(*(F.lit(float(x)) for x in lpf)), lambda a, b: a + b)
    found = adds.select(*SITE, joint.alias("joint"))
    top = F.array_max("joint")
    total = top + F.log(F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    best = F.array_position("joint", top).cast("int") - 1
    return found.select(*SITE, best.alias("best_k"), F.array(*(F.lit(float(x)) for x in f))[best].alias("best_freq"), F.transform("joint", lambda x: x - total).alias("log_post"))
