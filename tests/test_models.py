from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqmill.functions import numeric, prior
from seqmill.jobs import train
from seqmill.operators import likelihood, logit, network, simulate


@pytest.mark.parametrize(("a", "b"), [(1, 20), (1, 0.5), (3.5, 1), (0.2, 1)])
def test_betainc_closed_forms(a, b):
    x = np.linspace(0, 1, 41)
    want = 1 - (1 - x) ** b if a == 1 else x**a
    np.testing.assert_allclose(prior.betainc(a, b, x), want, atol=1e-12)


@pytest.mark.parametrize("p", [prior.Prior(1, 20, 0.9), prior.Prior(0.5, 50, 0.3), prior.Prior(2, 2, 0.01)])
def test_prior_sums_to_one(p):
    assert np.exp(p.log_probabilities(128)).sum() == pytest.approx(1, abs=1e-9)


def test_grid():
    v, f = prior.boundaries(5), prior.frequencies(5)
    assert v[0] == 0 and v[-1] == pytest.approx(0.5)
    np.testing.assert_allclose(f[1:], (v[:-1] + v[1:]) / 2)


def test_network_gradient():
    net = network.Network.random(5, 3, (4, 3))
    rng = np.random.default_rng(0)
    x, d = rng.normal(size=(6, 5)), rng.normal(size=(6, 4))
    log_p, kept = net.forward(x)
    np.testing.assert_allclose(np.exp(log_p).sum(1), 1)
    got, flat = net.backward(log_p, kept, d), net.flat
    for i in rng.integers(0, len(flat), 12):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = ((net.shaped(flat + s).forward(x)[0] * d).sum() for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def sample_frame(sites=3, rows=4, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([{"chrom": "c", "sample": "s", "pos": s, "in_major": rng.normal(size=3).tolist(), "in_minor": rng.normal(size=3).tolist(), **{n: int(rng.integers(0, 5)) for n in ("n_a", "n_c", "n_g", "n_t")}} for s in range(sites) for _ in range(rows)])


def test_site_gradient():
    frame, model = sample_frame(), train.Model(network.Network.random(3, 1, (4, 3)), prior.Prior(1.5, 8, 0.7), 12)
    gradient, share, evidence, sites = train.site_sums(frame, model)
    assert sites == 3 and share.sum() == pytest.approx(3)
    at = lambda flat, params: train.site_sums(frame, train.Model(model.network.shaped(flat), prior.Prior.of(params), 12))[2]
    flat, params = model.network.flat, model.prior.params
    for i in (0, 5, len(flat) - 1):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((at(flat + step, params) - at(flat - step, params)) / 2e-6, rel=1e-4, abs=1e-5)
    for i, g in enumerate(model.prior.gradient(12) @ share):
        step = np.eye(3)[i] * 1e-5
        assert g == pytest.approx((at(flat, params + step) - at(flat, params - step)) / 2e-5, rel=1e-4, abs=1e-5)


def test_training_lowers_the_loss(spark):
    rows = spark.createDataFrame(sample_frame(20, 6, 1))
    model = train.train(train.by_site(rows).persist(), train.Model(network.Network.random(3, 1, (4, 3)), prior.Prior(1, 20, 0.9), 12), 6, 0.05)
    assert len(model.losses) == 6 and model.losses[-1] < model.losses[0]


def test_weights_as_a_table(spark):
    net = network.Network.random(4, 2, (3,))
    np.testing.assert_allclose(network.Network.from_table(net.to_table(spark)).flat, net.flat)


def test_logit_gradient(spark):
    rows = spark.createDataFrame([("A", 1, [1.0, 0.5], 3, 1, 0, 2), ("A", 1, [1.0, -1.0], 0, 4, 1, 1), ("T", 2, [1.0, 2.0], 1, 1, 1, 5)], "base string, read_num int, x array<double>, n_a long, n_c long, n_g long, n_t long")
    values = np.random.default_rng(0).normal(size=48) / 3
    at = lambda v: logit.log_likelihood(rows, logit.coefficients(spark, list(v), 2)).first()[0]
    got = {(r.base, r.read_num, r.outcome, r.col): r.g for r in logit.gradient(rows, logit.coefficients(spark, list(values), 2)).collect()}
    for i, key in ((0, ("A", 1, 0, 0)), (3, ("A", 1, 1, 1)), (47, ("T", 2, 2, 1))):
        step = np.zeros(48)
        step[i] = 1e-5
        assert got[key] == pytest.approx((at(values + step) - at(values - step)) / 2e-5, abs=1e-4)


def test_column_functions(spark):
    x = F.col("id") - 2
    row = spark.range(5).filter("id = 4").select(numeric.logistic(x).alias("a"), numeric.d_logistic(x).alias("b"), numeric.softplus(x).alias("c"), numeric.logsumexp([x, x]).alias("d"), numeric.scientific(x.cast("double")).alias("e")).first()
    s = 1 / (1 + np.exp(-2))
    assert (row.a, row.b, row.c, row.d) == pytest.approx((s, s * (1 - s), np.log1p(np.exp(2)), 2 + np.log(2)))
    assert row.e == "2.00000000e+00"


def test_posterior_by_hand(spark):
    p = prior.Prior(1, 20, 0.9)
    grid = prior.grid(spark, 3, p)
    calls = spark.createDataFrame([("c", "s", 0, 2, 0.9, 0.1), ("c", "s", 0, 1, 0.05, 0.8)], "chrom string, sample string, pos int, n int, p_major double, p_minor double")
    likely = likelihood.grid_likelihood(calls, grid)
    f = prior.frequencies(3)
    joint = p.log_probabilities(3) + 2 * np.log(f * 0.1 + (1 - f) * 0.9) + np.log(f * 0.8 + (1 - f) * 0.05)
    want = joint - np.log(np.exp(joint).sum())
    post = likelihood.posterior(likely).orderBy("k").toPandas()
    np.testing.assert_allclose(post.log_post, want)
    assert likelihood.most_likely(likelihood.posterior(likely)).first().best_k == int(want.argmax())
    assert likelihood.loss(likely).first().loss == pytest.approx(-np.log(np.exp(joint).sum()))
    assert post.log_joint[0] == pytest.approx(np.log(0.9) + 2 * np.log(0.9) + np.log(0.05))  # at f = 0 the major allele alone


def test_packed_posterior_equals_the_grid_join(spark):
    p, f = prior.Prior(1, 20, 0.9), prior.frequencies(8)
    lp = np.log([[0.9, 0.05, 0.03, 0.02], [0.1, 0.7, 0.1, 0.1]])
    rows = spark.createDataFrame([("c", "s", i, 5 - i, i, 0, 0, lp[0].tolist(), lp[1].tolist()) for i in range(4)], "chrom string, sample string, pos int, n_a long, n_c long, n_g long, n_t long, lp_major array<double>, lp_minor array<double>")
    got = likelihood.packed_posterior(rows, f, p.log_probabilities(8)).orderBy("pos").toPandas()
    for i, r in got.iterrows():
        n = np.array([5 - i, i, 0, 0])
        joint = p.log_probabilities(8) + (n * np.log(f[:, None] * np.exp(lp[1]) + (1 - f[:, None]) * np.exp(lp[0]))).sum(1)
        np.testing.assert_allclose(r.log_post, joint - np.log(np.exp(joint).sum()))
        assert r.best_k == joint.argmax()


def test_simulation_is_seeded_and_recovered(spark):
    """Frequencies drawn for deep sites come back as the most likely ones, whatever the partitions."""
    f = prior.frequencies(8)
    even = np.full(8, 1 / 8)
    strong = [v for b in "ACGT" for _ in (1, 2) for o in "ACG" for v in ([6.0 if b == o else (-6.0 if b == "T" else 0.0)])]
    rows = spark.createDataFrame([("c", "s", i, False, 1, [1.0], 400, 0, 0, 0, "A", "C") for i in range(12)], "chrom string, sample string, pos int, is_reverse boolean, read_num int, x array<double>, n_a long, n_c long, n_g long, n_t long, major string, minor string")
    table = logit.coefficients(spark, strong, 1)
    one = simulate.simulate(rows.coalesce(1), table, f, even, 5).orderBy("pos").toPandas()
    two = simulate.simulate(rows.repartition(5), table, f, even, 5).orderBy("pos").toPandas()
    assert one[["n_a", "n_c", "true_freq"]].equals(two[["n_a", "n_c", "true_freq"]])
    assert (one[["n_a", "n_c", "n_g", "n_t"]].sum(axis=1) == 400).all()
    guess = f[np.abs(one.n_c.to_numpy()[:, None] / 400 - f).argmin(1)]
    assert np.mean(np.abs(guess - one.true_freq) < 0.08) > 0.9


def test_simulation_against_a_plain_loop(spark):
    """Every draw of two sites, one with an unseen minor allele, by a loop over their rows."""
    f, even = prior.frequencies(6), np.full(6, 1 / 6)
    values = (np.random.default_rng(4).normal(size=48)).tolist()
    schema = "chrom string, sample string, pos int, is_reverse boolean, read_num int, x array<double>, n_a long, n_c long, n_g long, n_t long, major string, minor string"
    data = [("c", "s", p, r, n, [1.0, d / 4], 9, 1, d, 2, "AC"[p], "TN"[p]) for p in (0, 1) for r in (False, True) for n in (1, 2) for d in (0, 3)]
    got = {(r.pos, r.is_reverse, r.read_num, r.x[1]): r for r in simulate.simulate(spark.createDataFrame(data, schema).repartition(3), logit.coefficients(spark, values, 2), f, even, 9).collect()}
    table, flip = np.array(values).reshape(4, 2, 3, 2), {"A": "T", "C": "G", "G": "C", "T": "A"}
    for p in (0, 1):
        rng = simulate.seeded(9, "c", "s", p)
        freq = float(rng.choice(f, p=even))
        minor = "T" if p == 0 else str(rng.choice(list("AGT")))
        for _, _, _, reverse, read_num, x, *n, major, _ in sorted(r for r in data if r[2] == p):
            total, counts = sum(n), np.zeros(4, int)
            k = int(rng.binomial(total, freq))
            for allele, m in ((minor, k), (major, total - k)):
                w = table["ACGT".index(flip[allele] if reverse else allele), read_num - 1] @ x
                e = np.exp([*w, 0.0])
                counts += rng.multinomial(m, e / e.sum())
            r = got[p, reverse, read_num, x[1]]
            assert [r.n_a, r.n_c, r.n_g, r.n_t] == counts.tolist() and r.true_freq == freq


def test_network_posterior_against_a_plain_sum(spark):
    """The registered query, site by site, from the same labelled observations."""
    from seqmill import queries
    from tests.oracle import SMALL

    net, f, lpf = queries.fixed_network(7), prior.frequencies(queries.POINTS), queries.PRIOR.log_probabilities(queries.POINTS)
    rows = queries._labelled(spark, SMALL).toPandas()
    flip = dict(zip("ACGT", "TGCA", strict=True))
    got = {(r.chrom, r.sample, r.pos): r for r in queries.network_posterior(spark, SMALL).collect()}
    joint = {}
    for r in rows.itertuples():
        minor = r.minor if r.minor != "N" else ("C" if r.major == "A" else "A")
        lp = []
        for allele in (r.major, minor):
            true = flip[allele] if r.is_reverse else allele
            lp.append(net.forward(np.array([[*r.x, r.read_num - 1, *(float(true == b) for b in "ACGT")]]))[0][0])
        n = np.array([r.n_a, r.n_c, r.n_g, r.n_t])
        term = (n * np.log(f[:, None] * np.exp(lp[1]) + (1 - f[:, None]) * np.exp(lp[0]))).sum(1)
        key = (r.chrom, r.sample, r.pos)
        joint[key] = joint.get(key, lpf) + term
    assert set(got) == set(joint)
    for key, j in joint.items():
        np.testing.assert_allclose(got[key].log_post, j - np.logaddexp.reduce(j), atol=2e-6)
        assert got[key].best_k == j.argmax()
