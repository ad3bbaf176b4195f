"""Training in buckets and pieces, saved versions, and the order of samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.functions.prior import Prior
from seqmill.jobs import collect, model, train
from seqmill.operators import network
from seqmill.sources import tables

WIDTH = 4


@pytest.fixture(scope="module")
def rows(spark):
    """60 sites of a few rows and one of many."""
    rng = np.random.default_rng(4)
    out = []
    for pos in range(61):
        for _ in range(900 if pos == 60 else int(rng.integers(1, 6))):
            out.append(("c", "s", pos, *map(int, rng.integers(0, 9, 4)), rng.random(WIDTH).tolist(), rng.random(WIDTH).tolist()))
    return spark.createDataFrame(out, "chrom string, sample string, pos int, n_a long, n_c long, n_g long, n_t long, in_major array<double>, in_minor array<double>").repartition(3).persist()


def start():
    return train.Model(network.Network.random(WIDTH, 1, (5, 3)), Prior(), 7)


def test_a_deep_site_in_pieces_has_the_same_gradient(spark, rows, monkeypatch):
    whole = train._sums(train.by_site(rows), start())
    pieces = train.by_site(rows, deep=50)
    assert pieces.filter("pos = 60").select("piece").distinct().count() == 18 and pieces.filter("pos < 60 and piece > 0").count() == 0
    monkeypatch.setattr(train, "CHUNK", 20)
    for a, b in zip(train._sums(pieces, start(), True), whole, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    one, two = (train.train(train.by_site(rows, d).persist(), start(), 2, 0.05) for d in (50, 10_000))
    np.testing.assert_allclose(one.network.flat, two.network.flat, rtol=1e-7)


def test_a_very_deep_site_ends(spark):
    """100,000 rows at one site, which no task holds."""
    deep = spark.range(100_000).select(F.lit("c").alias("chrom"), F.lit("s").alias("sample"), F.lit(1).alias("pos"), *(F.pmod(F.col("id") * k, F.lit(5)).alias(c) for k, c in enumerate(("n_a", "n_c", "n_g", "n_t"), 1)), *(F.array(*(F.rand(k * 9 + i) for i in range(WIDTH))).alias(c) for k, c in enumerate(("in_major", "in_minor"))))
    dealt = train.by_site(deep)
    sizes = dealt.groupBy("piece").count().collect()
    assert len(sizes) == 25 and max(r["count"] for r in sizes) < 1.2 * train.DEEP
    gradient, share, _, n = train._sums(dealt, start(), True)
    assert n == 1 and np.isfinite(gradient).all() and share.sum() == pytest.approx(1)


def test_a_step_reads_its_own_rows_only(spark, rows, tmp_path, monkeypatch):
    for folders in (1024, 5):
        monkeypatch.setattr(train, "FOLDERS", folders)
        b = train.write_buckets(rows, f"{tmp_path}/{folders}", batch_sites=10, seed=3, blocks=4, deep=200)
        assert b.batches == 7 and b.deep
        seen = [b.batch(2, k).select("pos").distinct().collect() for k in range(b.batches)]
        assert sorted(r["pos"] for x in seen for r in x) == list(range(61))
        assert b.parts(0, 0) != b.parts(1, 0) and b.parts(1, 0) == b.parts(1, 0)
        files = {f for k in range(2) for f in b.batch(0, k).inputFiles()}
        plan = b.batch(0, 0)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
        assert "In(part" in plan and files
    whole = b.rows.count()
    assert whole == rows.count()


def test_going_on_inside_an_epoch(spark, rows, tmp_path):
    b = train.write_buckets(rows, f"{tmp_path}/b", batch_sites=20, seed=3, blocks=2)
    saved = []
    whole = train.train(None, start(), 2, 0.05, save=saved.append, buckets=b)
    assert whole.position == (2, 0) and len(whole.losses) == 2 * b.batches
    half = saved[b.batches]  # one step into the second epoch
    assert half.position == (1, 1)
    model.save(half, [(0.0, 1.0)], spark, f"{tmp_path}/m")
    again, _ = model.load(spark, f"{tmp_path}/m")
    on = train.train(None, again, 1, 0.05, buckets=b)
    np.testing.assert_allclose(on.network.flat, whole.network.flat)
    assert on.losses == pytest.approx(whole.losses) and on.position == whole.position


def test_a_run_that_breaks_off_leaves_the_last_version(spark, rows, tmp_path, monkeypatch):
    folder = f"{tmp_path}/m"
    dealt = train.by_site(rows).persist()
    one = train.train(dealt, start(), 1, 0.05)
    two = train.train(dealt, one, 1, 0.05)
    three = train.train(dealt, two, 1, 0.05)
    model.save(one, [(0.0, 1.0)], spark, folder)
    with monkeypatch.context() as m:
        m.setattr(tables, "mark", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            model.save(two, [(0.0, 1.0)], spark, folder)
    back, _ = model.load(spark, folder)
    np.testing.assert_array_equal(back.network.flat, one.network.flat)
    assert back.losses == one.losses and back.position == (1, 0)
    for m in (two, three):
        model.save(m, [(0.0, 1.0)], spark, folder)
    back, _ = model.load(spark, folder)
    np.testing.assert_array_equal(back.network.flat, three.network.flat)
    assert back.losses == three.losses and back.trail == three.trail
    assert sorted(n for n in tables.names_in(spark, folder) if n.startswith("version")) == ["version=1", "version=2"]
    with pytest.raises(ValueError):
        model.load(spark, f"{tmp_path}/none")


def test_samples_keep_the_order_of_the_list(spark, tmp_path):
    """Files listed in reverse order of name: the first listed one is the baseline in both jobs."""
    rng = np.random.default_rng(9)
    for name in "ab":
        lines = ["@SQ\tSN:c1\tLN:60"]
        lines += [f"r{i}\t{rng.choice([0, 16])}\tc1\t{rng.integers(1, 30)}\t{rng.choice([30, 40])}\t9M\t*\t0\t0\t{''.join(rng.choice(list('ACGT'), 9))}\t{'I' * 9}" for i in range(80)]
        (tmp_path / f"{name}.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "list").write_text(f"{tmp_path}/b.sam\n{tmp_path}/a.sam\n")
    out = f"{tmp_path}/out"
    collect.main(spark, [f"{tmp_path}/list", "c1", out, "--min-coverage", "1", "--context-length", "1"])
    kept = [r["name"] for r in spark.read.parquet(f"{out}/covariates").filter("kept").orderBy("i").collect()]
    assert "a" in kept and "b" not in kept
    model.main(spark, ["train", f"{out}/observations", f"{tmp_path}/m", "--epochs", "1", "--num-frequencies", "6", "--batch-size", "10", "--save-every", "2", "--covariates", f"{out}/covariates"])
    model.main(spark, ["posterior", f"{out}/observations", f"{tmp_path}/p", "--model", f"{tmp_path}/m", "--covariates", f"{out}/covariates"])
    sites = spark.read.parquet(f"{out}/observations").filter("major <> 'N'").select(*train.SITE).distinct().count()
    assert spark.read.text(f"{tmp_path}/p").count() == sites
