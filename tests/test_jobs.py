"""Observations collected from derived reads, then trained on, scored and simulated by the model job."""

from __future__ import annotations

import numpy as np
import pytest

from seqmill.functions import prior
from seqmill.jobs import collect, model, train
from seqmill.operators import network
from seqmill.operators.calls import CallFilter
from seqmill.operators.observations import Covariates
from seqmill.sources import tables
from seqmill.sources.derived_reads import SAMPLES, reads_of


@pytest.fixture(scope="module")
def observations(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("jobs") / "observations")
    reads = reads_of(spark, "/root/testdata/sf0.001").filter("chrom = 'chrA'")
    covariates = Covariates(SAMPLES, context_length=1, use_bq=False, use_mq=False)
    collect.collect(reads, covariates, CallFilter(), 5)[1].write.parquet(folder)
    return folder


def test_train_then_posterior(spark, observations, tmp_path):
    model.main(spark, ["train", observations, f"{tmp_path}/m", "--epochs", "3", "--num-frequencies", "8"])
    losses = [r.loss for r in spark.read.parquet(f"{tmp_path}/m/metrics").orderBy("step").collect()]
    assert len(losses) == 3 and losses[-1] < losses[0]
    model.main(spark, ["posterior", observations, f"{tmp_path}/p", "--model", f"{tmp_path}/m"])
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/p").collect()]
    sites = spark.read.parquet(observations).select("chrom", "sample", "pos").distinct().count()
    assert len(lines) == sites and all(len(x) == 4 + 8 for x in lines)


def test_simulate(spark, observations, tmp_path):
    table = spark.read.parquet(observations)
    width = len(model.covariates_of(table).names)
    (tmp_path / "parameters").write_text("\n".join(["0.1"] * (24 * width) + ["0", "3", "2"]))
    model.main(spark, ["simulate", observations, f"{tmp_path}/s", "--parameters", f"{tmp_path}/parameters", "--num-frequencies", "8"])
    drawn = spark.read.parquet(f"{tmp_path}/s")
    total = "sum(n_a + n_c + n_g + n_t)"
    assert drawn.selectExpr(total).first()[0] == table.selectExpr(total).first()[0]


def test_batches_saving_and_going_on(spark, observations, tmp_path):
    """Two runs of two epochs, the second from what the first saved, are as one of four; batches are drawn from a seed."""
    dealt = train.by_site(train.model_inputs(model.encoded(table := spark.read.parquet(observations).filter("major <> 'N'"), model.covariates_of(table), None)[0])).persist()
    start = train.Model(network.Network.random(len(model.covariates_of(table).names) + 5, 0), prior.Prior(), 8)
    sites = table.select("chrom", "sample", "pos").distinct().count()
    saved = []
    whole = train.train(dealt, start, 2, 0.01, sites // 3, 7, saved.append, 2)
    steps = len(whole.losses)
    assert steps in (6, 8) and [len(m.losses) for m in saved] == list(range(2, steps + 1, 2)) and len(whole.trail) == steps
    half = train.train(dealt, start, 1, 0.01, sites // 3, 7)
    model.save(half, [(0.0, 1.0)], spark, f"{tmp_path}/half")
    again, _ = model.load(spark, f"{tmp_path}/half")
    np.testing.assert_allclose(train.train(dealt, again, 1, 0.01, sites // 3, 7).network.flat, whole.network.flat)
    other = train.train(dealt, start, 1, 0.01, sites // 3, 8)
    assert not np.allclose(other.network.flat, half.network.flat)
    per = dealt.select("chrom", "sample", "pos").distinct().groupBy(train.batch_of(train.SITE, 7, 0, 3).alias("b")).count().collect()
    assert sum(r["count"] for r in per) == sites and len(per) == 3
    dealt.unpersist()


def test_constant_covariates_go(spark, observations, tmp_path):
    table = spark.read.parquet(observations)
    covariates = model.covariates_of(table)
    kept = collect.covariate_table(table, covariates, False).collect()
    x = np.array([r.x for r in table.select(covariates.vector().alias("x")).distinct().collect()])
    want = [n for i, n in enumerate(covariates.names) if len(set(x[:, i])) > 1 or n == "const"]
    assert [r.name for r in kept] == covariates.names and [r.name for r in kept if r.kept] == want
    assert all(r.kept for r in collect.covariate_table(table, covariates, True).collect())
    collect.covariate_table(table, covariates, False).write.parquet(f"{tmp_path}/c")
    model.main(spark, ["train", observations, f"{tmp_path}/m", "--epochs", "1", "--num-frequencies", "8", "--covariates", f"{tmp_path}/c"])
    trained, ranges = model.load(spark, f"{tmp_path}/m")
    assert len(ranges) == len(want) and trained.network.weights[0].shape[0] == len(want) + 5
    model.main(spark, ["posterior", observations, f"{tmp_path}/p", "--model", f"{tmp_path}/m", "--covariates", f"{tmp_path}/c", "--grid-line"])
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/p").collect()]
    assert lines[0][0] == "#freqs" and len(lines[0]) == 9
    assert [(r[0], r[1], int(r[2])) for r in lines[1:]] == sorted((r.sample, r.chrom, r.pos) for r in table.filter("major <> 'N'").select("chrom", "sample", "pos").distinct().collect())


def test_references_by_existence(spark, tmp_path):
    contigs = spark.createDataFrame([("s", "chr1", 5), ("s", "chr2", 5)], "sample string, chrom string, length int")
    (tmp_path / "names").write_text("chr2\n")
    assert tables.reference_names(spark, str(tmp_path / "names"), contigs) == ["chr2"]
    assert tables.reference_names(spark, "chr1,chr2", contigs) == ["chr1", "chr2"]


def test_mixed_lists_of_files(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:9\nr\t0\tchr1\t1\t30\t3M\t*\t0\t0\tACG\tIII\n")
    reads, contigs = collect.read_alignments(spark, [str(tmp_path / "a.sam")])
    assert reads.count() == 1 and contigs.count() == 1
