"""Deep tables: signs of rounded numbers, narrow priors, and steps whose cost per read is high."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill import queries
from seqmill.functions import bases, numeric, prior
from seqmill.operators import observations, places, pileup
from seqmill.operators.calls import base_calls
from seqmill.sources import derived_reads
from tests.oracle import SMALL


def test_rounded_keeps_the_sign_of_what_becomes_zero(spark):
    rows = spark.createDataFrame([(0, -0.0004), (1, 0.0004), (2, -0.0005), (3, 1.2345), (4, 0.0), (5, None)], "i int, x double")
    got = rows.orderBy("i").select(numeric.scientific(numeric.rounded(rows.x, 3)).alias("s")).collect()
    assert [r.s for r in got][:5] == ["-0.00000000e+00", "0.00000000e+00", "-1.00000000e-03", "1.23500000e+00", "0.00000000e+00"]
    assert rows.filter("i = 5").select(numeric.rounded(rows.x, 3).alias("x")).first().x is None


@pytest.mark.parametrize("b", [790.0, 47_000.0])
def test_a_narrow_prior_keeps_the_windows_that_a_double_holds(b):
    got, v = prior.Prior(1.0, b, 0.9).log_probabilities(16), prior.boundaries(16)
    # log((1 - v0)^b - (1 - v1)^b), to which the mirror image adds nothing that a double shows, but in the last window
    want = [math.log(0.1) + b * math.log1p(-x) + math.log(-math.expm1(b * (math.log1p(-y) - math.log1p(-x)))) for x, y in zip(v[:-1], v[1:], strict=True)]
    told = np.array(want[:-1]) > -700  # below, doubles get coarse, and then end
    assert np.isfinite(got[1:-1][told]).all() and (got[1:-1][np.array(want[:-1]) < -750] == -np.inf).all()
    assert got[1:-1][told] == pytest.approx(np.array(want[:-1])[told], rel=1e-12)
    assert np.exp(got).sum() == pytest.approx(1, abs=1e-12)


@pytest.mark.parametrize(("a", "b"), [(2.5, 30.0), (0.3, 0.7), (1.0, 20.0), (4.0, 1.0), (1.0, 1.0)])
def test_prior_in_logs_equals_differences_of_betainc(a, b):
    v = prior.boundaries(16)
    mass = np.diff(prior.betainc(a, b, v)) + np.diff(prior.betainc(b, a, v))
    assert np.exp(prior.Prior(a, b, 0.5).log_probabilities(16)[1:]) * 2 == pytest.approx(mass, abs=1e-13)


@pytest.mark.parametrize("reads", [derived_reads.derived_reads, derived_reads.varied_reads])
def test_the_code_of_derived_reads_is_small_enough_to_be_compiled(spark, reads):
    plan = reads(spark.read.parquet(f"{SMALL}/lineitem.parquet"))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 8000  # the JVM interprets larger methods


def test_derived_reads_follow_the_formulas_of_their_letters(spark):
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    keys = lineitem.selectExpr("concat('s', cast(l_suppkey % 3 as string)) as sample", "cast((l_partkey*7 + l_linenumber*3) % 400 as int) as pos", "l_orderkey as ok", "l_partkey as pk", "l_linenumber as ln")
    for n in (derived_reads.LENGTH, max(derived_reads.SIZES)):
        got = derived_reads._letters(keys, n)
        letters = F.concat(*(F.expr(derived_reads._base(i)) for i in range(n)))
        qual = F.array(*(F.expr(f"cast(10 + (ok + {i * 5} + ln*3) % 31 as int)") for i in range(n)))
        assert got.filter((F.col("seq") != letters) | (F.col("qual") != qual)).count() == 0
        assert got.filter(F.col("seq") == letters).count() == lineitem.count()


def test_an_alignment_is_walked_once_and_in_steps_of_one_sum(spark):
    """Many operations, of which each kind moves the query, the reference, both or neither."""
    cigar = "3H2S" + "4M1I2M3D1=2N1X1P" * 50 + "5S"
    want, q, r = [], 2, 7
    for _ in range(50):
        for n, op in ((4, "M"), (1, "I"), (2, "M"), (3, "D"), (1, "="), (2, "N"), (1, "X")):
            want += [(q + i, r + i) for i in range(n)] if op in "M=X" else []
            q, r = q + n * (op in "M=XI"), r + n * (op in "M=XDN")
    rows = spark.createDataFrame([("s0", "c", 7, 0, 60, cigar, "A" * (q + 5), [30] * (q + 5)), ("s0", "c", 7, 0, 60, "0M", "", []), ("s0", "c", 7, 0, 60, None, "A", [30])], "sample string, chrom string, pos int, flag int, mapq int, cigar string, seq string, qual array<int>")
    seen = base_calls(rows)
    assert sorted((c.qpos, c.refpos) for c in seen.collect()) == want
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_of_a_small_limit_each_task_writes_its_first_reads_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(places, "stored", lambda table, name: written.append(table.count()) or table.persist())
    reads = spark.range(9000).select(F.when(F.col("id") % 9 > 0, "hot").otherwise("small").alias("sample"), "id").repartition(5, "id")
    assert {r["sample"]: r["count"] for r in places.limited(reads, 7).groupBy("sample").count().collect()} == {"hot": 7, "small": 7}
    assert written == [7 * 2 * 5]


def test_calls_at_few_sites_are_not_shuffled(spark, monkeypatch):
    reads = derived_reads.reads_of(spark, SMALL)
    sites = pileup.sites(pileup.pileup(reads)).persist()
    few = observations.observed_calls(reads, sites, queries.COVARIATES)
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(observations, "FEW", 0)
    many = observations.observed_calls(reads, sites, queries.COVARIATES)
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0 < few.count()


@pytest.mark.parametrize("name", ["minmax_normalized", "variable_columns"])
def test_statistics_read_distinct_rows_and_not_calls_again(spark, name):
    plan = getattr(queries, name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


def test_reads_are_dealt_so_that_calls_of_a_site_meet_and_tasks_stay_small(spark, monkeypatch):
    """tasks grow in number, not in size, and most calls of equal site and covariates lie in one task."""
    monkeypatch.setattr(derived_reads, "TASK_ROWS", 500)
    reads = derived_reads.placed_reads_of(spark, SMALL)
    tasks = reads.rdd.getNumPartitions()
    assert tasks > spark.sparkContext.defaultParallelism and derived_reads.reads_of(spark, SMALL).rdd.getNumPartitions() == tasks
    places = ["sample", "chrom", F.floor(F.col("pos") / 40), "flag", "mapq"]
    assert reads.select(*places, F.spark_partition_id()).distinct().count() == reads.select(*places).distinct().count()
    assert reads.exceptAll(derived_reads.reads_of(spark, SMALL)).count() == 0


def test_sites_are_summed_from_counted_calls_and_nothing_is_sorted(spark):
    """neither a window nor a sort over the collapsed rows."""
    got = observations.collapsed_reads(derived_reads.reads_of(spark, SMALL), queries.COVARIATES)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Generate" not in plan


@pytest.mark.parametrize("query", [queries.dense_positions, queries.dense_covariates])
def test_dense_queries_explode_reads_once(spark, query):
    """lengths and rows come from the same written counts."""
    plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan


def test_a_call_costs_no_pattern_and_no_translation(spark):
    """letters are cleaned and turned once a read; a call's base is compared, its context cut."""
    plan = observations.counted_reads(derived_reads.reads_of(spark, SMALL), queries.COARSE)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.rindex("Generate")]  # plans are printed from the last step to the first
    assert "regexp_replace" not in after and "translate" not in after


def test_contexts_cut_from_a_read_equal_those_cut_from_each_call(spark):
    rows = [(s, q, r, k) for s in ("ACGTNacx", "A", "", "TTGCA", None) for q in range(8) for r in (True, False) for k in (1, 2, 3) if r or q >= k]
    for k in (1, 2, 3):
        table = spark.createDataFrame([x[:3] for x in rows if x[3] == k], "seq string, qpos int, rev boolean")
        right = F.translate(F.reverse(F.substring("seq", F.col("qpos") + 2, F.lit(k))), "ACGT", "TGCA")
        left = F.substring("seq", F.col("qpos") - k + 1, F.lit(k))
        want = F.regexp_replace(F.when(F.col("rev"), right).otherwise(left), "[^ACGT]", "N")
        assert table.filter(~bases.context(F.col("seq"), F.col("qpos"), F.col("rev"), k).eqNullSafe(want)).count() == 0
