"""Dense numbers, limits, tiles, nested counts, tables of counts and refused loci."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill import queries
from seqmill.jobs import collect
from seqmill.operators import observations, pileup, places
from seqmill.operators.observations import Covariates
from seqmill.sources import alignments, tables
from tests.oracle import SMALL


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("x"), F.when(F.col("id") % 3 > 0, 1).alias("y")).repartition(7)
    told = places.numbered(rows, ["y", "x"], "nth").orderBy("nth").collect()
    assert [r["nth"] for r in told] == list(range(5000))
    assert [(r["y"] or 0, r["x"]) for r in told] == sorted((r["y"] or 0, r["x"]) for r in told)
    hot = places.numbered(rows.withColumn("z", F.lit(1)), ["z"])
    assert hot.select("id").distinct().count() == 5000 and hot.agg(F.max("id")).first()[0] == 4999
    assert places.numbered(rows.limit(0), ["x"]).count() == 0


def test_ids_join_back_with_and_without_salts(spark, monkeypatch):
    calls = queries._observed(spark, SMALL, queries.COARSE)
    rows = observations.collapse(calls, queries.COARSE)
    ids = places.covariate_ids(observations.dictionary_of_calls(calls, queries.COARSE), queries.COARSE)
    one = places.with_covariate_ids(rows, ids, queries.COARSE).groupBy("cov_id").agg(F.count("*").alias("n"), F.sum("n_a").alias("a")).orderBy("cov_id").collect()
    monkeypatch.setattr(places, "FEW", 0)
    assert one == places.with_covariate_ids(rows, ids, queries.COARSE).groupBy("cov_id").agg(F.count("*").alias("n"), F.sum("n_a").alias("a")).orderBy("cov_id").collect()
    assert sum(r["n"] for r in one) == rows.count() and len(one) == ids.count()


@pytest.mark.parametrize("few", [100_000, 0])
def test_exact_limits(spark, monkeypatch, few):
    monkeypatch.setattr(places, "FEW", few)
    reads = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("small").alias("sample"), "id").coalesce(5).repartition(6, "id")
    for n in (0, 1, 499, 2000, 9999):
        got = places.limited(reads, n)
        assert {r["sample"]: r["count"] for r in got.groupBy("sample").count().collect()} == {k: min(n, m) for k, m in (("hot", 2500), ("small", 500)) if n}
        assert got.columns == reads.columns and got.distinct().count() == got.count()


def test_tiles_hold_every_position(spark):
    seen = queries._observed(spark, SMALL, queries.COARSE)
    contigs = spark.createDataFrame([("chrA", "s0", 250), ("chrA", "none", 101), ("chrR", "s1", 0)], "chrom string, sample string, length int")
    tiles = {(r["sample"], r["tile"]): r["matrices"] for r in places.dense_covariates(seen, contigs, queries.COARSE, 100).collect()}
    assert {k: len(v) for k, v in tiles.items()} == {("s0", 0): 100, ("s0", 1): 100, ("s0", 2): 50, ("none", 0): 100, ("none", 1): 1}
    assert all(m == [] for k, v in tiles.items() if k[0] == "none" for m in v)
    have = seen.filter("chrom = 'chrA' and sample = 's0' and pos < 250").select("pos", *queries.COARSE.keys).distinct().count()
    assert sum(len(m) for k, v in tiles.items() if k[0] == "s0" for m in v) == have > 0


def test_nested_counts_are_extracted(spark):
    rows = observations.with_local_ids(observations.collapse(queries._observed(spark, SMALL, queries.COARSE), queries.COARSE), queries.COARSE)
    columns = [*places.SITE, "is_reverse", "read_num", "local_id", *places.COUNTS]
    back = places.extracted(places.nested(rows)).select(columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(columns).collect()))


def write_sam(path, seed):
    rng = np.random.default_rng(seed)
    lines = ["@SQ\tSN:c1\tLN:60", "@SQ\tSN:c2\tLN:60"]
    lines += [f"r{i}\t{rng.choice([0, 16])}\t{rng.choice(['c1', 'c2'])}\t{rng.integers(1, 30)}\t40\t9M\t*\t0\t0\t{''.join(rng.choice(list('ACGT'), 9))}\t{'I' * 9}" for i in range(120)]
    path.write_text("\n".join(lines) + "\n")


def test_counts_tables_are_taken_for_the_pileup(spark, tmp_path, monkeypatch):
    for seed, name in enumerate("ab"):
        write_sam(tmp_path / f"{name}.sam", seed)
    (tmp_path / "list").write_text(f"{tmp_path}/a.sam\n{tmp_path}/b.sam\n")
    collect.main(spark, [f"{tmp_path}/list", "c1,c2", f"{tmp_path}/plain", "--min-coverage", "1"])
    reads = alignments.read_sam(spark, f"{tmp_path}/a.sam")
    counts = {(r["chrom"], r["pos"]): r for r in pileup.stranded_pileup(reads, 20).collect()}
    (tmp_path / "counts").mkdir()
    for chrom in ("c1", "c2"):
        cells = [[counts[chrom, p][f"{s}_{b}"] if (chrom, p) in counts else 0 for b in "acgt" for s in "fr"] for p in range(60)]
        text = "# made at 20\nA\ta\tC\tc\tG\tg\tT\tt\n" + "".join("\t".join(map(str, c)) + "\n" for c in cells)
        (tmp_path / "counts" / f"a.{chrom}.bq20.counts").write_text(text)
        (tmp_path / "counts" / f"b.{chrom}.bq30.counts").write_text("A\ta\tC\tc\tG\tg\tT\tt\n9\t9\t9\t9\t9\t9\t9\t9\n")  # of another threshold
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # a table is read in several parts
    try:
        assert tables.read_counts(spark, f"{tmp_path}/counts/a.c1.bq20.counts", "c1", "a").rdd.getNumPartitions() > 2
        collect.main(spark, [f"{tmp_path}/list", "c1,c2", f"{tmp_path}/kept", "--min-coverage", "1", "--counts", f"{tmp_path}/counts"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for table in ("sites", "observations"):
        one, two = (sorted(map(str, spark.read.parquet(f"{tmp_path}/{x}/{table}").collect())) for x in ("plain", "kept"))
        assert one == two and one
    assert tables.kept_counts(spark, f"{tmp_path}/counts", ["a", "b"], ["c1", "c2"], 20)[1] == [("c1", "a"), ("c2", "a")]


def test_a_locus_is_written_once(spark, tmp_path):
    for seed, name in enumerate("ab"):
        write_sam(tmp_path / f"{name}.sam", seed)
        (tmp_path / f"list_{name}").write_text(f"{tmp_path}/{name}.sam\n")
    job = lambda name: collect.main(spark, [f"{tmp_path}/list_{name}", "c1", f"{tmp_path}/out", "--min-coverage", "1", "--append"])
    job("a")
    n = spark.read.parquet(f"{tmp_path}/out/sites").count()
    with pytest.raises(ValueError, match="written already"):
        job("a")
    assert spark.read.parquet(f"{tmp_path}/out/sites").count() == n
    job("b")
    assert {r["sample"] for r in spark.read.parquet(f"{tmp_path}/out/sites").select("sample").distinct().collect()} == {"a", "b"}
    twice = spark.read.parquet(f"{tmp_path}/out/sites")
    with pytest.raises(ValueError, match="twice"):
        tables.add_sites(twice.union(twice), f"{tmp_path}/other", places.SITE)
    assert not tables.exists(spark, f"{tmp_path}/other")
