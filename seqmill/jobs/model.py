"""Job: train on collected observations, or write posteriors, or simulate.

    python -m seqmill.jobs.model train OBSERVATIONS MODEL --epochs 20
    python -m seqmill.jobs.model posterior OBSERVATIONS OUTPUT --model MODEL
    python -m seqmill.jobs.model simulate OBSERVATIONS OUTPUT --parameters FILE
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.functions.prior import Prior, frequencies
from seqmill.jobs import train as training
from seqmill.operators import likelihood, logit, network, simulate
from seqmill.operators.observations import CONTAM, Covariates
from seqmill.operators.pileup import COUNTS
from seqmill.sources import tables


def covariates_of(observations: DataFrame, samples: tuple[str, ...] | None = None) -> Covariates:
    """The covariates that a table of observations was collapsed by; samples in the order given, or else of name."""
    have = set(observations.columns)
    first = observations.select(F.length("context").alias("n")).first()
    known = {"chrom", "sample", "pos", "is_reverse", "read_num", "bq", "mapq", "dend_bin", "context", "major", "minor", *CONTAM, *COUNTS}
    samples = samples or tuple(r[0] for r in observations.select("sample").distinct().orderBy("sample").collect())
    return Covariates(samples, first["n"] if first else 0, use_bq="bq" in have, use_mq="mapq" in have, use_distance="dend_bin" in have, use_contamination=set(CONTAM) <= have, user=tuple(c for c in observations.columns if c not in known))


def ranges_of(rows: DataFrame, width: int) -> list[tuple[float, float]]:
    """The least and most of each number of x; one aggregate."""
    r = rows.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("low", F.min), ("high", F.max)))).first()
    return [(r[f"low{i}"], r[f"high{i}"]) for i in range(width)]


def varying(names: list[str], ranges: list[tuple[float, float]]) -> list[str]:
    """The names of columns that vary, and of those that are constantly 1 the first."""
    ones = [n for n, r in zip(names, ranges, strict=True) if r == (1.0, 1.0)][:1]
    return [n for n, (low, high) in zip(names, ranges, strict=True) if low != high or n in ones]


def encoded(observations: DataFrame, covariates: Covariates, ranges: list[tuple[float, float]] | None, names: list[str] | None = None) -> tuple[DataFrame, list[tuple[float, float]]]:
    """observations with x, the covariates (of `names` if given) scaled to 0..1 but for the constant, and each one's range."""
    rows = observations.withColumn("x", covariates.vector())
    if names is not None:
        rows = rows.withColumn("x", F.array(*(F.col("x")[covariates.names.index(n)] for n in names)))
    if ranges is None:
        found = ranges_of(rows, len(names or covariates.names))
        ranges = [(0.0, 1.0) if n == "const" else r for n, r in zip(names or covariates.names, found, strict=True)]
    scaled = [((F.col("x")[i] - low) / (high - low)) if high > low else F.lit(0.0) for i, (low, high) in enumerate(ranges)]
    return rows.withColumn("x", F.array(*scaled)), ranges


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a saved model that were written to the end, oldest first."""
    return [n for n in sorted(int(v.removeprefix("version=")) for v in tables.names_in(spark, folder) if v.startswith("version=")) if tables.exists(spark, f"{folder}/version={n}/_COMPLETE")]


def save(model: training.Model, ranges: list[tuple[float, float]], spark: SparkSession, folder: str) -> None:
    """Write the model as a version of its own, which counts from the moment that its mark is there; the one before is kept.

    The metrics of the steps since the version before lie beside it, once each.
    """
    have = _complete(spark, folder)
    at = f"{folder}/version={have[-1] + 1 if have else 0}"

    def written(rows: list[tuple], ddl: str, path: str) -> None:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(path)

    model.network.to_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{at}/weights")
    prior, adam = model.prior, model.adam or training.Adam()
    steps = spark.read.parquet(f"{folder}/version={have[-1]}/prior").first()["steps"] if have else 0
    steps = steps if steps < len(model.losses) else 0
    new = [(i, float(x), *t) for i, (x, t) in enumerate(zip(model.losses, model.trail, strict=True)) if i >= steps]
    written(new, "step int, loss double, a double, b double, prob_0 double", f"{folder}/metrics/after={steps}")
    written([(prior.a, prior.b, prior.z, model.points, *model.position, len(model.losses))], "a double, b double, z double, points int, epoch int, batch int, steps int", f"{at}/prior")
    written([(i, *map(float, r)) for i, r in enumerate(ranges)], "i int, low double, high double", f"{at}/ranges")
    size = len(model.network.flat) + 3
    moments = [np.broadcast_to(np.asarray(m, float), size).tolist() for m in (adam.first, adam.second)]
    written([(i, adam.step, *m) for i, m in enumerate(zip(*moments, strict=True))], "i int, step int, first double, second double", f"{at}/optimiser")
    tables.mark(spark, f"{at}/_COMPLETE")
    for old in have[:-1]:
        tables.delete(spark, f"{folder}/version={old}")


def load(spark: SparkSession, folder: str) -> tuple[training.Model, list[tuple[float, float]]]:
    """What save() wrote last and to the end: weights, prior, metrics and the optimiser's state, all of the size of the model or its steps."""
    have = _complete(spark, folder)
    if not have:
        raise ValueError(f"{folder} holds no model that was saved to the end")
    at = f"{folder}/version={have[-1]}"
    p = spark.read.parquet(f"{at}/prior").first()
    ranges = [(r.low, r.high) for r in spark.read.parquet(f"{at}/ranges").orderBy("i").collect()]
    # a run that broke off may have left later steps, and steps that were then done again
    told = spark.read.parquet(f"{folder}/metrics").filter(F.col("step") < p.steps)
    metrics = told.groupBy("step").agg(F.max_by(F.struct("loss", "a", "b", "prob_0"), "after").alias("m")).orderBy("step").select("m.*").collect()
    moments = spark.read.parquet(f"{at}/optimiser").orderBy("i").collect()
    adam = training.Adam(step=moments[0].step, first=np.array([m.first for m in moments]), second=np.array([m.second for m in moments]))
    net = network.Network.from_table(spark.read.parquet(f"{at}/weights"))
    return training.Model(net, Prior(p.a, p.b, p.z), p.points, [m.loss for m in metrics], [(m.a, m.b, m.prob_0) for m in metrics], adam, (p.epoch, p.batch)), ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("step", choices=["train", "posterior", "simulate"])
    p.add_argument("observations")
    p.add_argument("output")
    p.add_argument("--model", help="folder of a trained model to go on from or to use")
    p.add_argument("--parameters", help="simulate: text file of coefficients and the three prior parameters, one a line")
    p.add_argument("--num-frequencies", type=tables.positive, default=128)
    p.add_argument("--epochs", type=tables.positive, default=20)
    p.add_argument("--rate", type=float, default=0.01)
    p.add_argument("--batch-size", type=tables.positive, help="train: sites of a step, which reads them alone from buckets written beside the model; all if not given")
    p.add_argument("--save-every", type=tables.positive, help="train: save after so many steps; at the end if not given")
    p.add_argument("--covariates", help="table of the collect job that says which covariates are kept, beside its table of samples in their order")
    p.add_argument("--grid-line", action="store_true", help="posterior: begin with a line of the grid's frequencies")
    p.add_argument("--seed", type=int, default=0)
    return p


def main(spark: SparkSession, args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    observations = spark.read.parquet(a.observations).filter("major <> 'N'")
    order = f"{a.covariates.rstrip('/').rpartition('/')[0]}/samples" if a.covariates else ""
    listed = tuple(r["sample"] for r in spark.read.parquet(order).orderBy("i").collect()) if order and tables.exists(spark, order) else None
    covariates = covariates_of(observations, listed)
    model, ranges = load(spark, a.model) if a.model else (None, None)
    names = [r["name"] for r in spark.read.parquet(a.covariates).filter("kept").orderBy("i").collect()] if a.covariates else covariates.names
    rows, ranges = encoded(observations, covariates, ranges, names)
    if a.step == "train":
        inputs = training.model_inputs(rows)
        start = model or training.Model(network.Network.random(len(names) + 5, a.seed), Prior(), a.num_frequencies)
        keep = (lambda m: save(m, ranges, spark, a.output)) if a.save_every else None
        if a.batch_size:
            buckets = training.write_buckets(inputs, f"{a.output}/batches", a.batch_size, a.seed)
            trained = training.train(None, start, a.epochs, a.rate, None, a.seed, keep, a.save_every or 1, buckets)
        else:
            dealt = training.by_site(inputs).persist()
            trained = training.train(dealt, start, a.epochs, a.rate, None, a.seed, keep, a.save_every or 1)
            dealt.unpersist()
        save(trained, ranges, spark, a.output)
    elif a.step == "posterior":
        if model is None:
            raise ValueError("posterior needs --model")
        scored = network.with_allele_probabilities(rows, model.network)
        post = likelihood.packed_posterior(scored, frequencies(model.points), model.prior.log_probabilities(model.points))
        tables.write_posterior(post, a.output, frequencies(model.points).tolist() if a.grid_line else None)
    else:
        values = [float(r.value) for r in spark.read.text(a.parameters).collect() if r.value.strip()]
        prior = Prior.of(np.array(values[-3:]))
        drawn = simulate.simulate(rows, logit.coefficients(spark, values[:-3], len(names)), frequencies(a.num_frequencies), np.exp(prior.log_probabilities(a.num_frequencies)), a.seed)
        drawn.drop("x").write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main(SparkSession.builder.appName("model").getOrCreate())
