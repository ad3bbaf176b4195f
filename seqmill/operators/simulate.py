"""Simulated observations from a multinomial-logit error model and a frequency prior.

Every draw of a site comes from a generator seeded with (seed, chrom, sample, pos), so the
result does not depend on partitions or on lost tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from seqmill.functions.bases import BASES

from . import logit
from .pileup import COUNTS

SITE = ["chrom", "sample", "pos"]


def seeded(seed: int, *key: object) -> np.random.Generator:
    digest = hashlib.blake2b("\0".join(map(str, (seed, *key))).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def simulate(observations: DataFrame, coefficients: DataFrame, f: np.ndarray, prior: np.ndarray, seed: int) -> DataFrame:
    """observations with counts drawn anew, and the true frequency of each site.

    observations: SITE, is_reverse, read_num, x, n_a .. n_t, major, minor. A site's frequency is
    drawn from the prior; of each row's calls a binomial number come from the minor allele, and
    the observed bases of either allele are multinomial. Reverse reads use complemented alleles;
    a minor allele that was never seen is drawn from the other bases. Sites without a major allele go.
    """
    rows = observations.filter("major <> 'N'")
    error = logit.matrices(coefficients)
    p = prior / prior.sum()
    flip = dict(zip(BASES, reversed(BASES), strict=True))

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, rng, major, minor, true_freq = None, None, "", "", 0.0
        for frame in frames:
            counts, freqs = [], []
            rows = zip(*(frame[c] for c in (*SITE, "is_reverse", "read_num", "x", "major", "minor")), frame[COUNTS].sum(axis=1), strict=True)
            for *key, reverse, read_num, x, first, second, n in rows:
                if key != site:
                    site, rng = key, seeded(seed, *key)
                    true_freq = float(rng.choice(f, p=p))
                    major = first
                    minor = second if second != "N" else str(rng.choice([b for b in BASES if b != first]))
                got, n_minor = np.zeros(4, np.int64), int(rng.binomial(int(n), true_freq))
                for allele, m in ((minor, n_minor), (major, int(n) - n_minor)):
                    odds = np.append(error[flip[allele] if reverse else allele, read_num] @ x, 0.0)
                    q = np.exp(odds - odds.max())
                    got += rng.multinomial(m, q / q.sum())
                counts.append(got)
                freqs.append(true_freq)
            if counts:
                frame[COUNTS] = np.array(counts)
                yield frame.assign(true_freq=freqs)

    dealt = rows.repartition(*SITE).sortWithinPartitions(*SITE, "is_reverse", "read_num", "x")
    return dealt.mapInPandas(drawn, StructType([*rows.schema.fields, StructField("true_freq", DoubleType())]))
