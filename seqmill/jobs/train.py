"""Training: the network and the prior by Adam on the driver, gradients summed on the executors.

A step is one pass over a batch of sites, all of them or a part that a seed draws anew each epoch.
by_site() deals the observations so that a site is whole, and a deep one in pieces; keep its result with persist(), and lost
parts are dealt again. write_buckets() writes them in blocks of sites that a step prunes to: an epoch shuffles the
blocks, and a step reads its own ones and nothing else. The evidence of a deep site is summed over its pieces first, and its
posterior is then joined to them for the gradient, so no task holds a site of more than `DEEP` rows. A task returns the sums of its sites; they are added in the JVM, so the driver
gets one number for each parameter and grid point. A model holds what a later run needs to go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.functions.prior import Prior, frequencies
from seqmill.operators.network import Network, model_input, true_bases
from seqmill.operators.pileup import COUNTS

SITE = ["chrom", "sample", "pos"]
#: Rows of a site that are held together, and rows that are scored at a time in a deeper one.
DEEP, CHUNK = 4096, 2000
#: Folders of buckets; of more parts than that, several share a folder and are told apart by their row groups.
FOLDERS = 1024


@dataclass
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7
    step: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def change(self, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = self.beta1 * self.first + (1 - self.beta1) * gradient
        self.second = self.beta2 * self.second + (1 - self.beta2) * gradient**2
        m, v = self.first / (1 - self.beta1**self.step), self.second / (1 - self.beta2**self.step)
        return -self.rate * m / (np.sqrt(v) + self.eps)


@dataclass
class Model:
    network: Network
    prior: Prior
    points: int = 128
    losses: list[float] = field(default_factory=list)
    #: a, b and the probability of 0 after each step, beside the losses before it.
    trail: list[tuple[float, float, float]] = field(default_factory=list)
    adam: Adam | None = None
    #: The epoch and the batch of the next step.
    position: tuple[int, int] = (0, 0)


def _terms(frame: pd.DataFrame, model: Model):
    """Network outputs for both alleles, the two parts and their logsumexp by row, grid point and base, and the counts."""
    f = frequencies(model.points)
    with np.errstate(divide="ignore"):
        log_f, log_1mf = np.log(f)[None, :, None], np.log1p(-f)[None, :, None]
    both = [model.network.forward(np.stack(frame[c].to_numpy())) for c in ("in_major", "in_minor")]
    a, b = log_1mf + both[0][0][:, None, :], log_f + both[1][0][:, None, :]
    return both, a, b, np.logaddexp(a, b), frame[COUNTS].to_numpy(float)[:, None, :]


def site_sums(frame: pd.DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Of whole sites: the network's gradient of the summed evidence, the grid's responsibilities, the evidence, the sites.

    frame: SITE, in_major and in_minor (network inputs), n_a .. n_t; rows of a site are adjacent.
    """
    lpf = model.prior.log_probabilities(model.points)
    codes = frame.groupby(SITE, sort=False).ngroup().to_numpy()
    n = codes.max() + 1
    both, a, b, terms, counts = _terms(frame, model)
    per_site = np.zeros((n, model.points))
    np.add.at(per_site, codes, (terms * counts).sum(2))
    joint = per_site + lpf
    top = joint.max(1, keepdims=True)
    evidence = top[:, 0] + np.log(np.exp(joint - top).sum(1))
    share = np.exp(joint - evidence[:, None])
    weighted = share[codes][:, :, None] * counts
    gradient = sum(model.network.backward(log_p, kept, (weighted * np.exp(part - terms)).sum(1)) for (log_p, kept), part in zip(both, (a, b), strict=True))
    return gradient, share.sum(0), float(evidence.sum()), int(n)


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), CHUNK):
            yield frame.iloc[at : at + CHUNK]


def _deep_sums(pieces: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, float, int]:
    """As site_sums(), of sites in pieces: the grid's sums of all pieces first, then the gradient under the sites' posteriors."""
    kinds = dict(pieces.dtypes)
    site = ", ".join(f"{c} {kinds[c]}" for c in SITE)

    def grid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _chunks(frames):
            _, _, _, terms, counts = _terms(frame, model)
            told = frame[SITE].reset_index(drop=True)
            told["v"] = list((terms * counts).sum(2))
            yield told.groupby(SITE, sort=False, dropna=False)["v"].apply(lambda v: np.sum(np.stack(v), 0)).reset_index()

    def posterior(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lpf = model.prior.log_probabilities(model.points)
        for frame in frames:
            if len(frame):
                joint = np.stack(frame["v"].to_numpy()) + lpf
                top = joint.max(1, keepdims=True)
                evidence = top[:, 0] + np.log(np.exp(joint - top).sum(1))
                yield frame[SITE].assign(share=list(np.exp(joint - evidence[:, None])), evidence=evidence)

    def gradient(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(model.network.flat))
        for frame in _chunks(frames):
            both, a, b, terms, counts = _terms(frame, model)
            weighted = np.stack(frame["share"].to_numpy())[:, :, None] * counts
            total += sum(model.network.backward(log_p, kept, (weighted * np.exp(part - terms)).sum(1)) for (log_p, kept), part in zip(both, (a, b), strict=True))
        yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": total})

    points = pieces.mapInPandas(grid, f"{site}, v array<double>").select(*SITE, F.posexplode("v").alias("k", "v")).groupBy(*SITE, "k").agg(F.sum("v").alias("v"))
    sums = points.groupBy(*SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    shares = sums.mapInPandas(posterior, f"{site}, share array<double>, evidence double").persist()
    totals = shares.agg(F.sum("evidence").alias("evidence"), F.count("*").alias("n"), *(F.sum(F.col("share")[k]).alias(f"k{k}") for k in range(model.points))).first()
    # a piece meets its site's posterior by site and piece, so a very deep site is spread like its pieces
    by_piece = pieces.select(*SITE, "piece").distinct().join(shares.select(*SITE, "share"), SITE)
    got = pieces.join(by_piece, [*SITE, "piece"]).mapInPandas(gradient, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
    shares.unpersist()
    if not totals["n"]:
        return np.zeros(len(model.network.flat)), np.zeros(model.points), 0.0, 0
    return got, np.array([totals[f"k{k}"] for k in range(model.points)]), totals["evidence"], totals["n"]


def _sums(observations: DataFrame, model: Model, deep: bool = False, rows: int = 2000) -> tuple[np.ndarray, np.ndarray, float, int]:
    """As site_sums(), of all sites; deep: whether some are in pieces."""
    if deep:
        parts = zip(_sums(observations.filter("piece = 0"), model, False, rows), _deep_sums(observations.filter("piece > 0"), model), strict=True)
        return tuple(a + b for a, b in parts)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = None, None

        def add(frame: pd.DataFrame) -> None:
            nonlocal total
            parts = np.concatenate([np.atleast_1d(x) for x in site_sums(frame, model)])
            total = parts if total is None else total + parts

        for frame in frames:
            if frame.empty:
                continue
            held = frame if held is None else pd.concat([held, frame])
            if len(held) >= rows:  # the last site may go on
                last = (held[SITE] == held[SITE].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    add(held[~last])
                    held = held[last]
        if held is not None:
            add(held)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": total})

    got = observations.mapInPandas(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
    size = len(model.network.flat)
    if not len(got):
        return np.zeros(size), np.zeros(model.points), 0.0, 0
    return got[:size], got[size : size + model.points], float(got[-2]), int(got[-1])


def model_inputs(rows: DataFrame) -> DataFrame:
    """SITE, counts, in_major and in_minor of rows (x, read_num, is_reverse, major, minor)."""
    true = true_bases(rows)
    inputs = [model_input(F.col("x"), F.col("read_num"), F.col(f"true_{a}")).alias(f"in_{a}") for a in ("major", "minor")]
    return true.select(*SITE, *COUNTS, *inputs)


def in_pieces(observations: DataFrame, deep: int = DEEP) -> tuple[DataFrame, bool]:
    """observations with `piece`, 0 for the rows of sites that have up to `deep` of them, and else from 1; and whether there are such sites.

    Pieces are drawn by a hash of the row, so that parts that are made again are the same.
    """
    sizes = observations.groupBy(*SITE).agg(F.ceil(F.count("*") / deep).cast("int").alias("pieces")).filter("pieces > 1")
    n = sizes.count()
    if not n:
        return observations.withColumn("piece", F.lit(0)), False
    told = observations.join(F.broadcast(sizes) if n <= 100_000 else sizes, SITE, "left")
    drawn = F.when(F.col("pieces").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*observations.columns), F.col("pieces")))
    return told.withColumn("piece", drawn.cast("int")).drop("pieces").select(*observations.columns, "piece"), True


def by_site(observations: DataFrame, deep: int = DEEP) -> DataFrame:
    """observations dealt by site and sorted, so that each site, or a piece of a deep one, lies whole in one task."""
    return in_pieces(observations, deep)[0].repartition(*SITE, "piece").sortWithinPartitions(*SITE, "piece")


def batch_of(sites: list[str], seed: int, epoch: int, batches: int) -> Column:
    """The batch that a site falls into in an epoch."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), *sites), F.lit(batches))


@dataclass
class Buckets:
    """Observations that lie in `batches` * `blocks` parts of sites; a batch of an epoch is `blocks` parts that a seed draws."""

    rows: DataFrame
    batches: int
    blocks: int
    seed: int
    deep: bool

    def parts(self, epoch: int, batch: int) -> list[int]:
        drawn = np.random.default_rng([self.seed, epoch]).permutation(self.batches * self.blocks)
        return sorted(drawn[batch * self.blocks : (batch + 1) * self.blocks].tolist())

    def batch(self, epoch: int, batch: int) -> DataFrame:
        """The rows of a batch, dealt by site; no other file or row group is read."""
        parts, per = self.parts(epoch, batch), -(-self.batches * self.blocks // FOLDERS)
        some = self.rows.filter(F.col("bucket").isin(sorted({p // per for p in parts})) & F.col("part").isin(parts)).drop("bucket", "part")
        return some.repartition(*SITE, "piece").sortWithinPartitions(*SITE, "piece")


def write_buckets(observations: DataFrame, folder: str, batch_sites: int, seed: int = 0, blocks: int = 8, deep: int = DEEP) -> Buckets:
    """Write observations to `folder` by parts of sites, each drawn once by a seeded hash; sorted, so that a part's rows lie together."""
    pieces, has_deep = in_pieces(observations, deep)
    sites = observations.select(*SITE).distinct().count()
    batches = max(1, math.ceil(sites / batch_sites))
    per = -(-batches * blocks // FOLDERS)
    told = pieces.withColumn("part", batch_of(SITE, seed, -1, batches * blocks).cast("int")).withColumn("bucket", F.floor(F.col("part") / per).cast("int"))
    told.repartition("bucket", "piece").sortWithinPartitions("bucket", "part", *SITE, "piece").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return Buckets(observations.sparkSession.read.schema(told.schema).parquet(folder), batches, blocks, seed, has_deep)


def train(observations: DataFrame | None, model: Model, epochs: int, rate: float = 0.01, batch_sites: int | None = None, seed: int = 0, save: Callable[[Model], None] | None = None, save_every: int = 1, buckets: Buckets | None = None) -> Model:
    """The model after `epochs` passes over the sites of observations, which are dealt by site, or over buckets.

    batch_sites: sites of a step on average, all if not given; each epoch draws its batches anew. save is called
    with the model after every `save_every` steps. A model that has been trained goes on where it was, also inside an epoch,
    which then counts as one of the passes.
    """
    adam = replace(model.adam, rate=rate) if model.adam else Adam(rate)
    size = len(model.network.flat)
    if buckets is not None:
        batches, deep = buckets.batches, buckets.deep
    else:
        batches = 1 if batch_sites is None else max(1, math.ceil(observations.select(*SITE).distinct().count() / batch_sites))
        deep = "piece" in observations.columns and bool(observations.filter("piece > 0").limit(1).count())
    first, began = model.position
    for epoch in range(first, first + epochs):
        for batch in range(began if epoch == first else 0, batches):
            if buckets is not None:
                some = buckets.batch(epoch, batch)
            else:
                some = observations if batches == 1 else observations.filter(batch_of(SITE, seed, epoch, batches) == batch)
            gradient, share, evidence, sites = _sums(some, model, deep)
            then = (epoch, batch + 1) if batch + 1 < batches else (epoch + 1, 0)
            if not sites:
                model = replace(model, position=then)
                continue
            prior = model.prior.gradient(model.points) @ share
            change = adam.change(-np.concatenate([gradient, prior]) / sites)
            now = Prior.of(np.clip(model.prior.params + change[size:], -12, 12))
            model = Model(model.network.shaped(model.network.flat + change[:size]), now, model.points, [*model.losses, -evidence / sites], [*model.trail, (float(now.a), float(now.b), float(now.z))], replace(adam), then)
            if save is not None and len(model.losses) % save_every == 0:
                save(model)
    return model
