"""The registered queries of the read operators, over reads derived from the lineitem table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqmill.functions import bases, numeric, prior
from seqmill.jobs import train as training
from seqmill.operators import likelihood, logit, network, observations, pileup, places, simulate
from seqmill.operators.calls import SKIPPED_FLAGS, CallFilter, base_calls, forward_calls, with_bins
from seqmill.sources.derived_reads import SAMPLES, placed_reads_of, reads_of, varied_reads_of
from seqmill.sources.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
SITE = ["chrom", "sample", "pos"]
COVARIATES = observations.Covariates(SAMPLES)
POINTS = 16
PRIOR = prior.Prior(1.0, 20.0, 0.9)
#: A coarse encoding for models: distance, context and contamination.
COARSE = observations.Covariates(SAMPLES, context_length=1, use_bq=False, use_mq=False, use_sample=False)


def _pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup(reads_of(spark, sf_dir))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.sites(_pileup(spark, sf_dir))


def _observed(spark: SparkSession, sf_dir: str, covariates: observations.Covariates = COVARIATES) -> DataFrame:
    return observations.observed_calls(reads_of(spark, sf_dir), stored(_sites(spark, sf_dir), "sites"), covariates)


def _collapsed(spark: SparkSession, sf_dir: str, covariates: observations.Covariates = COVARIATES) -> DataFrame:
    # with base qualities a task of any reads keeps most calls apart, so reads are dealt by where they lie
    reads = placed_reads_of(spark, sf_dir) if covariates.use_bq else reads_of(spark, sf_dir)
    return observations.collapsed_reads(reads, covariates)


def _flag(c: Column) -> Column:
    return c.cast("int")


def base_calls_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = base_calls(reads_of(spark, sf_dir), CallFilter(), 2)
    keys = ["sample", "chrom", "refpos", "is_reverse", "read_num", "base", "context"]
    return calls.withColumn("is_reverse", _flag(F.col("is_reverse"))).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("bq").alias("sum_bq"), F.sum("mapq").alias("sum_mq"))


def complement_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_of(spark, sf_dir).select("seq").distinct()
    first = F.substring("seq", 1, 1)
    return reads.select("seq", bases.complement(F.col("seq")).alias("complement"), bases.complement_base(first).alias("first"), bases.base_index(first).alias("first_index"))


def read_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = base_calls(reads_of(spark, sf_dir), CallFilter(0, 0), 3)
    return calls.groupBy("context", _flag(F.col("is_reverse")).alias("is_reverse"), "qpos").agg(F.count("*").alias("n"))


def distance_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = base_calls(reads_of(spark, sf_dir), CallFilter(0, 0))
    return calls.groupBy(_flag(F.col("is_reverse")).alias("is_reverse"), "dend", bases.rounded(F.col("dend"), 10).alias("by_10"), bases.rounded(F.col("dend"), 5).alias("by_5")).agg(F.count("*").alias("n"))


def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir)


def pileup_strand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.merge_strands(pileup.stranded_pileup(reads_of(spark, sf_dir)))


def consensus_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir).select(*SITE, pileup.consensus(20).alias("consensus"), pileup.consensus(120).alias("consensus_120"))


def major_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir).select(*SITE, *pileup.alleles())


def base_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir).select(*SITE, *(F.round(f, 6).alias(n) for f, n in zip(pileup.base_frequencies(), ("f_a", "f_c", "f_g", "f_t"), strict=True)))


def candidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir).filter(pileup.is_candidate(0.02)).select(*SITE)


def contamination_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select(*SITE, "consensus", *observations.CONTAM)


def region_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bins(reads_of(spark, sf_dir), 50).groupBy("chrom", "sample", "bin").agg(F.count("*").alias("n"))


def covariate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observed(spark, sf_dir).select(*COVARIATES.keys).distinct()
    at = {n: i for i, n in enumerate(COVARIATES.names)}
    x = COVARIATES.vector()
    shown = rows.select(x.alias("x"))
    code = reduce(lambda a, b: a + b, [F.col("x")[at[f"p{k}"]] * (i + 1) for i, k in enumerate(bases.kmers(2))])
    one_hot = reduce(lambda a, b: a + b, [F.col("x")[at[s]] * (i + 1) for i, s in enumerate(SAMPLES[1:])])
    named = [F.col("x")[at[n]].alias(n) for n in ("const", "bq", "mq", "dend", "contamA", "contamC", "contamG", "contamT")]
    return shown.select(F.size("x").alias("width"), *named, code.alias("context_code"), one_hot.alias("sample_code"))


def covariate_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.dictionary_of_calls(_observed(spark, sf_dir), COVARIATES)


def collapsed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collapsed(spark, sf_dir)
    return rows.withColumn("is_reverse", _flag(F.col("is_reverse")))


def local_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations.with_local_ids(_collapsed(spark, sf_dir, COARSE), COARSE)
    return rows.select(*SITE, _flag(F.col("is_reverse")).alias("is_reverse"), "read_num", *COARSE.keys, "local_id")


def variable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, as Spark leaves a distinct() out below counts of distinct values, which copy each call for each column
    rows = stored(_observed(spark, sf_dir).select("bq", "mapq", "dend_bin", *observations.CONTAM).distinct(), "distinct")
    numbers = rows.select(F.lit(1).alias("const"), "bq", "mapq", "dend_bin", *observations.CONTAM, F.lit(1).alias("unit"), F.lit(0).alias("zero"))
    return observations.variable_columns(observations.column_statistics(numbers, numbers.columns))


def minmax_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_observed(spark, sf_dir).select("bq", "mapq", "dend_bin").distinct(), "distinct")
    low = observations.column_statistics(rows, rows.columns).collect()
    scaled = observations.normalise(rows, {r["name"]: (r["low"], r["high"]) for r in low})
    return scaled.select(*(F.round(c, 6).alias(c) for c in rows.columns))


def locus_key_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both sides are a row a site and are read several times
    counts = stored(_pileup(spark, sf_dir), "pileup")
    seen = stored(observations.observed_calls(reads_of(spark, sf_dir), stored(pileup.sites(counts), "sites"), COVARIATES).select(*SITE).distinct(), "seen")
    missing = observations.missing_keys(counts, seen, SITE)
    return missing.groupBy("side").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def dense_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(_pileup(spark, sf_dir), "pileup")  # a row a site, read twice: for the lengths and to be filled up
    contigs = counts.groupBy("chrom", "sample").agg((F.max("pos") + 5).alias("length"))
    return pileup.dense(counts, contigs).select(*SITE, *pileup.COUNTS)


def freq_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reads_of(spark, sf_dir).agg(F.count_distinct("pos").cast("int").alias("n")).first()["n"]
    table = prior.grid(spark, max(points, 2))
    return table.select("k", F.round("f", 9).alias("f"), F.round(F.when(F.col("k") > 0, F.col("log_f")), 9).alias("log_f"), F.round("log_1mf", 9).alias("log_1mf"))


def prior_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sample a prior with a = 1 and b a tenth of its mean coverage."""
    means = _pileup(spark, sf_dir).groupBy("sample").agg(F.round(F.avg(pileup.coverage()) / 10).alias("b"))

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"sample": r.sample, "k": range(POINTS), "lpf": prior.Prior(1.0, r.b, 0.9).log_probabilities(POINTS)})

    return means.mapInPandas(tables, "sample string, k int, lpf double").select("sample", "k", F.round("lpf", 8).alias("lpf"))


def prior_betainc_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta mass below each site's minor fraction, with its counts as parameters."""
    counts = _pileup(spark, sf_dir).filter("n_a > 0 and n_c > 0")
    x = F.col("n_a") / pileup.coverage()
    return counts.select(*SITE, F.round(prior.betainc_column(F.col("n_a").cast("double"), F.col("n_c").cast("double"), x), 9).alias("mass"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collapsed(spark, sf_dir, COARSE)
    true = F.when(F.col("is_reverse"), F.translate("major", "ACGT", "TGCA")).otherwise(F.col("major"))
    return rows.select(*SITE, "is_reverse", "read_num", "major", "minor", true.alias("base"), "dend_bin", *pileup.COUNTS, F.array(F.lit(1.0), F.col("dend_bin") / 10.0).alias("x"))


#: 8 regressions x 3 outcomes x 2 columns.
COEFFICIENTS = [((i * 7) % 11 - 5) / 10 for i in range(48)]


def multinomial_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = logit.coefficients(spark, COEFFICIENTS, 2)
    return logit.log_likelihood(_labelled(spark, sf_dir), table).select(F.round("loglik", 4).alias("loglik"))


def multinomial_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = logit.coefficients(spark, COEFFICIENTS, 2)
    return logit.gradient(_labelled(spark, sf_dir), table).select("base", "read_num", "outcome", "col", F.round("g", 4).alias("g"))


def fixed_network(inputs: int, sizes: tuple[int, ...] = (32, 16, 4)) -> network.Network:
    """Weights ((3 i + 5 j + 7 layer) mod 13 - 6) / 20 and biases ((j + layer) mod 5 - 2) / 10."""
    net, rows = network.Network([], []), inputs
    for k, cols in enumerate(sizes):
        i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        net.weights.append(((3 * i + 5 * j + 7 * k) % 13 - 6) / 20)
        net.biases.append(((np.arange(cols) + k) % 5 - 2) / 10)
        rows = cols
    return net


def nn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select("dend_bin", "read_num", "base").distinct()
    inputs = rows.withColumn("input", network.model_input(F.array(F.lit(1.0), F.col("dend_bin") / 10.0), F.col("read_num"), F.col("base")))
    scored = network.with_log_probabilities(inputs, fixed_network(7))
    return scored.select("dend_bin", "read_num", "base", *(F.round(F.col("log_p")[i], 6).alias(f"lp_{b.lower()}") for i, b in enumerate(bases.BASES)))


def _phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as a pileup takes them, collapsed to (site, bq, base), with phred error probabilities."""
    calls = forward_calls(reads_of(spark, sf_dir), CallFilter.for_pileup())
    coarse = calls.groupBy("chrom", "sample", F.col("refpos").alias("pos"), "bq", "base").agg(F.count("*").alias("n"))
    # the pileup is a further sum of the same rows, so reads are exploded once; sites then stay where they are
    site = Window.partitionBy(*SITE)
    counts = [F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).over(site).alias(c) for b, c in zip(bases.BASES, pileup.COUNTS, strict=True)]
    return likelihood.with_phred_probabilities(coarse.select("*", *counts).select("*", *pileup.alleles()))


def _likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.grid_likelihood(_phred(spark, sf_dir), prior.grid(spark, POINTS, PRIOR))


def grid_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _likelihood(spark, sf_dir).select(*SITE, "k", F.round("loglik", 6).alias("loglik"))


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.posterior(_likelihood(spark, sf_dir)).select(*SITE, "k", F.round("log_joint", 6).alias("log_joint"), F.round("log_post", 6).alias("log_post"))


def map_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = likelihood.most_likely(likelihood.posterior(_likelihood(spark, sf_dir)))
    return best.select(*SITE, "best_k", F.round("best_freq", 6).alias("best_freq"), F.round("log_post", 6).alias("log_post"))


def global_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.loss(_likelihood(spark, sf_dir)).select(F.round("loss", 5).alias("loss"), "sites")


def posterior_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior as it is written out: numbers in scientific notation."""
    post = likelihood.posterior(_likelihood(spark, sf_dir))
    return post.select(*SITE, "k", numeric.scientific(numeric.rounded(F.col("log_post"), 3)).alias("log_post"))


def posterior_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is written out of each site: best_freq and the log-posterior of every grid point, in scientific notation."""
    post = likelihood.posterior(_likelihood(spark, sf_dir))
    best = F.max_by("f", F.struct("log_post", -F.col("k")))
    values = F.transform(F.array_sort(F.collect_list(F.struct("k", "log_post"))), lambda x: numeric.scientific(numeric.rounded(x["log_post"], 3)))
    return post.groupBy(*SITE).agg(best.alias("best"), values.alias("log_post")).select(*SITE, numeric.scientific(F.round("best", 6)).alias("best_freq"), "log_post")


def network_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely frequency of each site under a neural error model, on the packed path."""
    keyed = network.with_allele_probabilities(_labelled(spark, sf_dir), fixed_network(7))
    f, lpf = prior.frequencies(POINTS), PRIOR.log_probabilities(POINTS)
    return likelihood.packed_posterior(keyed, f, lpf).select(*SITE, "best_k", "best_freq", F.transform("log_post", lambda x: F.round(x, 6)).alias("log_post"))


def simulated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = prior.frequencies(POINTS), np.exp(PRIOR.log_probabilities(POINTS))
    drawn = simulate.simulate(_labelled(spark, sf_dir).drop("base"), logit.coefficients(spark, COEFFICIENTS, 2), f, p, seed=1)
    return drawn.select(*SITE, "is_reverse", "read_num", "dend_bin", *pileup.COUNTS, "true_freq")


def trained_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and prior parameters over a few training steps."""
    both = training.model_inputs(_labelled(spark, sf_dir))
    dealt = training.by_site(both).persist()
    model = training.train(dealt, training.Model(network.Network.random(7), PRIOR, POINTS), epochs=3, rate=0.02)
    dealt.unpersist()
    steps = [(i, float(x), float(model.prior.a), float(model.prior.b), float(model.prior.z)) for i, x in enumerate(model.losses)]
    return spark.createDataFrame(steps, "step int, loss double, a double, b double, z double")


def walked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of reads with indels, clips, skipped stretches, unknown bases, flags and two lengths."""
    calls = base_calls(varied_reads_of(spark, sf_dir), CallFilter(20, 20, SKIPPED_FLAGS), 2)
    keys = ["chrom", "sample", F.col("refpos").alias("pos"), _flag(F.col("is_reverse")).alias("is_reverse"), "read_num", "base", "context", "dend"]
    return calls.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("qpos").alias("sum_qpos"), F.sum("bq").alias("sum_bq"))


def varied_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup(varied_reads_of(spark, sf_dir))


def global_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the number of their covariates in the whole data set."""
    collapsed = stored(_collapsed(spark, sf_dir, COARSE), "collapsed")
    ids = places.covariate_ids(observations.dictionary(collapsed, COARSE), COARSE)
    rows = places.with_covariate_ids(collapsed, ids, COARSE)
    return rows.select(*SITE, _flag(F.col("is_reverse")).alias("is_reverse"), "read_num", "cov_id", *pileup.COUNTS)


def limited_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reads of each sample are left of its first 1,500."""
    return places.limited(reads_of(spark, sf_dir).select("sample"), 1500).groupBy("sample").agg(F.count("*").alias("n"))


def dense_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 100 positions: how many distinct covariates each position has, and a sum over them."""
    counted = stored(observations.counted_reads(reads_of(spark, sf_dir), COARSE), "counted")
    seen, counts = observations.collapsed_counts(counted, COARSE), observations.piled_counts(counted)
    contigs = counts.groupBy("chrom", "sample").agg((F.max("pos") + 5).alias("length"))
    tiles = places.dense_covariates(seen, contigs, COARSE, 100)
    bins = F.aggregate(F.flatten("matrices"), F.lit(0).cast("long"), lambda a, x: a + x["dend_bin"].cast("long"))
    return tiles.select("chrom", "sample", "tile", F.array_join(F.transform("matrices", lambda m: F.size(m).cast("string")), ",").alias("sizes"), bins.alias("sum_dend"))


def nested_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's counts as arrays by strand and read number, each entry as local_id:n_a:n_c:n_g:n_t."""
    sites = places.nested(observations.with_local_ids(_collapsed(spark, sf_dir, COARSE), COARSE))
    return sites.select(*SITE, *(F.transform(n, lambda e: F.concat_ws(":", e["local_id"], *(e[c] for c in pileup.COUNTS))).alias(n) for n in places.ORIENTATIONS))


ALL = [
    map_frequency, base_calls_filtered, complement_bases, read_context, distance_binned, pileup_counts, pileup_strand_merge,
    consensus_calls, major_minor, base_frequencies, candidate_sites, contamination_fractions, region_bins, covariate_rows,
    covariate_dictionary, collapsed_observations, local_row_ids, variable_columns, minmax_normalized, locus_key_parity,
    dense_positions, freq_grid, prior_logprob, prior_betainc_general, multinomial_loglik, multinomial_gradient, nn_forward,
    grid_loglik, posterior, global_loss, posterior_table, posterior_lines, walked_calls, varied_pileup, network_posterior, simulated_observations, trained_prior,
    global_row_ids, limited_reads, dense_covariates, nested_observations,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from seqmill import oracle

    return oracle.sql()
