"""The multinomial-logit error model: one regression for each (true base, read number).

Coefficients are a table: base, read_num, outcome (0, 1, 2 for A, C, G; T is the reference),
col, b. Log-likelihood and gradient are sums that Spark aggregates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.functions.bases import BASES
from seqmill.functions.numeric import log_softmax

from .pileup import COUNTS

KEY = ["base", "read_num"]


def coefficients(spark: SparkSession, values: list[float], columns: int) -> DataFrame:
    """The table from a flat list: for A1, A2, C1, .. T2 and each outcome, `columns` numbers."""
    rows = []
    keys = [(b, r) for b in BASES for r in (1, 2)]
    if len(values) != len(keys) * 3 * columns:
        raise ValueError(f"{len(values)} coefficients, but {len(keys) * 3 * columns} are needed")
    for i, v in enumerate(values):
        regression, rest = divmod(i, 3 * columns)
        outcome, col = divmod(rest, columns)
        rows.append((*keys[regression], outcome, col, float(v)))
    return spark.createDataFrame(rows, "base string, read_num int, outcome int, col int, b double")


def _wide(table: DataFrame) -> DataFrame:
    """base, read_num and an array of coefficients for each outcome: eight rows, so it may be broadcast."""
    per = table.groupBy(*KEY, "outcome").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "b"))), lambda x: x["b"]).alias("b"))
    return per.groupBy(*KEY).agg(*(F.max(F.when(F.col("outcome") == o, F.col("b"))).alias(f"b{o}") for o in range(3)))


def log_probabilities(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (base, read_num, x) with lp_a .. lp_t."""
    joined = rows.join(F.broadcast(_wide(table)), KEY)
    dot = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    odds = [dot(f"b{o}") for o in range(3)]
    linear = joined.select(*[F.col(f"`{c}`") for c in rows.columns], *(o.alias(f"__o{i}") for i, o in enumerate(odds)))
    lp = log_softmax([F.col(f"__o{i}") for i in range(3)] + [F.lit(0.0)])
    return linear.select(*[F.col(f"`{c}`") for c in rows.columns], *(p.alias("lp_" + c[2:]) for p, c in zip(lp, COUNTS, strict=True)))


def matrices(table: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The coefficients of each (base, read_num) as three rows; the table has 24 numbers for each covariate."""
    rows = table.collect()
    width = 1 + max(r["col"] for r in rows)
    found = {(r["base"], r["read_num"]): np.zeros((3, width)) for r in rows}
    for r in rows:
        found[r["base"], r["read_num"]][r["outcome"], r["col"]] = r["b"]
    return found


def log_likelihood(rows: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the sum over rows and bases of count x log-probability."""
    scored = log_probabilities(rows, table)
    return scored.agg(sum((F.sum(F.col(c) * F.col("lp_" + c[2:])) for c in COUNTS[1:]), F.sum(F.col("n_a") * F.col("lp_a"))).alias("loglik"))


def gradient(rows: DataFrame, table: DataFrame) -> DataFrame:
    """base, read_num, outcome, col, g: the derivative of log_likelihood by each coefficient."""
    scored = log_probabilities(rows, table)
    n = sum((F.col(c) for c in COUNTS[1:]), F.col("n_a"))
    parts = F.array(*(F.struct(F.lit(o).alias("outcome"), (F.col(c) - n * F.exp(F.col("lp_" + c[2:]))).alias("d")) for o, c in enumerate(COUNTS[:3])))
    by_outcome = scored.select(*KEY, "x", F.explode(parts).alias("o"))
    by_col = by_outcome.select(*KEY, F.col("o.outcome").alias("outcome"), F.col("o.d").alias("d"), F.posexplode("x").alias("col", "v"))
    return by_col.groupBy(*KEY, "outcome", "col").agg(F.sum(F.col("d") * F.col("v")).alias("g"))
