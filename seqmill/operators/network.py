"""The neural error model: softplus layers and a softmax over the four observed bases.

Its inputs are a call's covariates, the read number and a one-hot of the true base in sequencing
order. It is evaluated once for each distinct (covariates, read number, true base) of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from seqmill.functions.bases import BASES

HIDDEN = (32, 16)


@dataclass
class Network:
    """weights[i] is (inputs, outputs) of layer i, biases[i] its constants."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @staticmethod
    def random(inputs: int, seed: int = 0, hidden: tuple[int, ...] = HIDDEN) -> Network:
        """Uniform starting weights scaled by the layer's width."""
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 4]
        limits = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        return Network([rng.uniform(-u, u, (a, b)) for u, a, b in zip(limits, sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]])

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for pair in zip(self.weights, self.biases, strict=True) for x in pair])

    def shaped(self, flat: np.ndarray) -> Network:
        """A network like this one with other numbers."""
        out, at = Network([], []), 0
        for w, b in zip(self.weights, self.biases, strict=True):
            out.weights.append(flat[at : at + w.size].reshape(w.shape))
            out.biases.append(flat[at + w.size : at + w.size + b.size])
            at += w.size + b.size
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log-probabilities of the four bases, and what backward() needs."""
        kept = [x]
        for w, b in zip(self.weights[:-1], self.biases[:-1], strict=True):
            x = np.logaddexp(0, x @ w + b)
            kept.append(x)
        z = x @ self.weights[-1] + self.biases[-1]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), kept

    def backward(self, log_p: np.ndarray, kept: list[np.ndarray], d: np.ndarray) -> np.ndarray:
        """The flat gradient of a sum whose derivative by log_p is d."""
        d = d - np.exp(log_p) * d.sum(1, keepdims=True)
        parts: list[np.ndarray] = []
        for i in reversed(range(len(self.weights))):
            parts = [(kept[i].T @ d).ravel(), d.sum(0), *parts]
            if i:
                d = (d @ self.weights[i].T) * -np.expm1(-kept[i])  # softplus' = 1 - exp(-softplus)
        return np.concatenate(parts)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """layer, i, j, w; biases have i = -1."""
        rows = [(k, i, j, float(v)) for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)) for (i, j), v in [*np.ndenumerate(w), *(((-1, j), v) for j, v in enumerate(b))]]
        return spark.createDataFrame(rows, "layer int, i int, j int, w double")

    @staticmethod
    def from_table(table: DataFrame) -> Network:
        """The table has as many rows as the network has numbers."""
        frame = table.toPandas()
        net = Network([], [])
        for _, part in sorted(frame.groupby("layer"), key=lambda x: x[0]):
            w = np.zeros((part.i.max() + 1, part.j.max() + 1))
            inner, bias = part[part.i >= 0], part[part.i < 0].sort_values("j")
            w[inner.i, inner.j] = inner.w
            net.weights.append(w)
            net.biases.append(bias.w.to_numpy())
        return net


def model_input(x: Column, read_num: Column, true_base: Column) -> Column:
    """Covariates, read number (0 or 1) and the true base as a vector."""
    return F.concat(x, F.array((read_num - 1).cast("double"), *((true_base == b).cast("double") for b in BASES)))


def true_bases(rows: DataFrame) -> DataFrame:
    """rows (is_reverse, major, minor) with true_major and true_minor in sequencing order.

    A minor allele that was never seen is the first base that is not major.
    """
    seen = F.when(F.col("minor") == "N", F.when(F.col("major") == "A", "C").otherwise("A")).otherwise(F.col("minor"))
    flip = lambda c: F.when(F.col("is_reverse"), F.translate(c, "ACGT", "TGCA")).otherwise(c)
    return rows.withColumn("true_major", flip(F.col("major"))).withColumn("true_minor", flip(seen))


def with_allele_probabilities(rows: DataFrame, network: Network) -> DataFrame:
    """rows (x, read_num, is_reverse, major, minor) with lp_major and lp_minor, arrays over the observed bases.

    The network is evaluated where the rows are, once for each distinct input of an Arrow batch, so nothing is
    shuffled or joined on the wide covariates.
    """
    keyed = true_bases(rows)
    inputs = [model_input(F.col("x"), F.col("read_num"), F.col(f"true_{a}")).alias(f"in_{a}") for a in ("major", "minor")]
    names = [F.col(f"`{c}`") for c in rows.columns if c not in ("lp_major", "lp_minor")]
    kept = [f for f in rows.schema.fields if f.name not in ("lp_major", "lp_minor")]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            both = np.concatenate([np.stack(frame[c].to_numpy()) for c in ("in_major", "in_minor")])
            kinds, where = np.unique(both, axis=0, return_inverse=True)
            log_p = network.forward(kinds)[0][where.ravel()]
            yield frame.drop(columns=["in_major", "in_minor"]).assign(lp_major=list(log_p[: len(frame)]), lp_minor=list(log_p[len(frame) :]))

    schema = StructType([*kept, *(StructField(f"lp_{a}", ArrayType(DoubleType())) for a in ("major", "minor"))])
    return keyed.select(*names, *inputs).mapInPandas(scored, schema)


def with_log_probabilities(rows: DataFrame, network: Network, column: str = "input", into: str = "log_p") -> DataFrame:
    """rows with an array of four log-probabilities, from an array column of inputs."""

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                frame[into] = list(network.forward(np.stack(frame[column].to_numpy()))[0])
                yield frame

    return rows.mapInPandas(scored, StructType([*rows.schema.fields, StructField(into, ArrayType(DoubleType()))]))
