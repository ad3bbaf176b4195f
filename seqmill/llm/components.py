"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, parts_for, stash


def _settled(edges: DataFrame, bound: int) -> tuple[DataFrame, tuple]:
    cores = edges.sparkSession.sparkContext.defaultParallelism
    edges = stash(edges.distinct().coalesce(parts_for(bound, least=cores)), "edges")
    mark = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")).first()
    return edges, (mark["n"], mark["s"])


def _least(pairs: DataFrame, bound: int) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v; a hot u is spread over tasks.

    bound: at least as many as there are different u.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return keyed_join(pairs, least.coalesce(parts_for(bound, least=cores)), "u", bound)


def components(edges: DataFrame, bound: int) -> DataFrame:
    """id, component for every id in edges (u, v): component is the least id it can reach.

    bound: at least as many as there are edges. Each round is two grouped minima and joins over
    the edges, which never grow in number; edges between equal ids are allowed. The rounds end
    when the edges are stars.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, mark = _settled(edges, bound)
    loops = edges.filter("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    edges = edges.filter("u > v")
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * mark[0]).filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large, 2 * mark[0])
        small = small.filter("u > m").select("u", F.col("m").alias("v")).union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges, after = _settled(small, mark[0])
        if after == mark:
            break
        mark = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("id").agg(F.min("component").alias("component"))
