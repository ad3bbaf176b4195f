"""Places in a whole: dense numbers over all rows, exact limits, tiles of positions and nested counts of a site.

Nothing here is a window over all rows: a number is a task's offset, from the counts of all tasks, and the place in the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill.operators.observations import Covariates
from seqmill.operators.pileup import COUNTS, SITE
from seqmill.sources.tables import stored

#: Rows up to which a side of a join is broadcast.
FEW = 100_000
ORIENTATIONS = {"f1": (False, 1), "f2": (False, 2), "r1": (True, 1), "r2": (True, 2)}


def numbered(rows: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    """rows, written in the order of `columns`, with their place in it from 0; rows that are equal in them in no stated order.

    Rows are dealt by ranges and sorted there; what each task holds is counted, and its offset joined back.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    told = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    counts = told.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"))  # a row a task
    return told.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def covariate_ids(dictionary: DataFrame, covariates: Covariates) -> DataFrame:
    """The distinct covariates of a data set with cov_id, their place in order from 0."""
    return numbered(dictionary, list(covariates.keys), "cov_id")


def with_covariate_ids(observations: DataFrame, ids: DataFrame, covariates: Covariates, salts: int = 16) -> DataFrame:
    """observations with the cov_id of their covariates.

    ids has one row for each; it is broadcast if counted as few, else both sides are dealt by a salt too, as some covariates
    are in very many observations.
    """
    keys = list(covariates.keys)
    slim = ids.select(F.struct(*keys).alias("_key"), "cov_id")
    keyed = observations.withColumn("_key", F.struct(*keys))
    n = slim.count()
    if n <= FEW:
        return keyed.join(F.broadcast(slim), "_key").drop("_key")
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(*SITE, "read_num"), F.lit(salts)).cast("int"))
    copies = slim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["_key", "_salt"]).drop("_key", "_salt")


def limited(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads of each sample, exactly n where there are as many, in the order in which they are read.

    Of a small n each task keeps its first n of a sample, so little is written. Reads are counted by task and sample; of
    most tasks all or none are kept, and only those that hold a sample's cut number their reads of it.
    """
    told = reads.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    if n <= FEW:  # the first n of each task are told before any shuffle
        first = Window.partitionBy("sample", "_part").orderBy("_at")
        told = told.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= n).drop("_nth")
    told = stored(told, "limited")
    counts = told.groupBy("sample", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("sample").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    cuts = counts.select("sample", "_part", "_n", (F.lit(n) - F.coalesce(before, F.lit(0))).alias("_room")).filter("_room > 0")
    few = cuts.count() <= FEW
    kept = told.join(F.broadcast(cuts) if few else cuts, ["sample", "_part"])
    whole = kept.filter("_n <= _room")
    nth = F.row_number().over(Window.partitionBy("sample", "_part").orderBy("_at"))
    cut = kept.filter("_n > _room").withColumn("_nth", nth).filter("_nth <= _room").drop("_nth")
    return whole.unionByName(cut).select(*reads.columns)


def dense_covariates(observations: DataFrame, contigs: DataFrame, covariates: Covariates, tile: int = 1000) -> DataFrame:
    """chrom, sample, tile and matrices: for each position of the tile the array of its distinct covariates, empty where none were seen.

    contigs: chrom, sample, length. A row is a tile, so positions without observations are never rows.
    """
    keys = [c for c in covariates.keys if c != "sample"]
    sites = observations.groupBy(*SITE).agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("rows"))
    held = sites.groupBy("chrom", "sample", F.floor(F.col("pos") / tile).cast("int").alias("tile")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % tile).alias("at"), "rows"))).alias("held"))
    tiles = contigs.filter("length > 0").select("chrom", "sample", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / tile).cast("int"))).alias("tile"))
    empty = F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in observations.select(*keys).dtypes))), lambda _: F.lit(False))
    size = F.least(F.lit(tile), F.col("length") - F.col("tile") * tile).cast("int")
    filled = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at("held", i), empty))
    return tiles.join(held, ["chrom", "sample", "tile"], "left").select("chrom", "sample", "tile", filled.alias("matrices"))


def nested(observations: DataFrame) -> DataFrame:
    """A row a site with f1, f2, r1 and r2: arrays of (local_id, n_a .. n_t) by strand and read number, by local_id."""
    entry = F.struct("local_id", *COUNTS)
    arrays = [F.array_sort(F.collect_list(F.when((F.col("is_reverse") == reverse) & (F.col("read_num") == num), entry))).alias(name) for name, (reverse, num) in ORIENTATIONS.items()]
    return observations.groupBy(*SITE).agg(*arrays)


def extracted(sites: DataFrame) -> DataFrame:
    """The rows of nested(): SITE, is_reverse, read_num, local_id and counts."""
    def rows(name: str, reverse: bool, num: int) -> Column:
        return F.transform(name, lambda e: F.struct(F.lit(reverse).alias("is_reverse"), F.lit(num).alias("read_num"), e["local_id"].alias("local_id"), *(e[c].alias(c) for c in COUNTS)))

    return sites.select(*SITE, F.inline(F.flatten(F.array(*(rows(name, r, k) for name, (r, k) in ORIENTATIONS.items())))))
