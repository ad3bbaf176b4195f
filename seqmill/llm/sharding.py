"""Shards by a hierarchical weighted hash tree.

A layout is a tree of regions, racks and shards; a shard has a weight, and racks and regions weigh what
their shards do. A document goes down the tree: on every level each child of its node draws
-ln(u) / weight, u being a hash of doc_id and the child's name in (0, 1), and the least draw takes
the document. So a child gets its weight's part of the node's documents, and the draws of one node tell
nothing of another's.

Law `key`: doc_id and the layout decide, rows are not counted. When weights grow, a draw of their
subtrees alone falls: on every level rows move into subtrees that grew and nowhere else, and subtrees
whose inner weights stay keep the inner places of the rows they keep. `grown` adds a shard as a region of
its own, so one more shard takes rows only into itself.

`write_shards` writes a folder a shard, with the rows' slots: their order by a hash of doc_id, gapless from 0.
Rows are dealt by ranges of (shard, hash, arrival), so neither a shard nor a repeated doc_id is one task;
numbers come from the counts of each task's rows by shard, which are joined back.

Cases: a null doc_id is a key of its own, the same for all nulls; rows of one doc_id go to one shard, each
with a slot of its own, in no stated order among themselves; a null text has size 1 and the crc of an
empty text, and is written as null; size and crc are of whole texts of any length; an empty table gives empty shards; other columns are handed on, inside
a column `doc`, so they may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_join, stash_at

#: Draws are hashes over 2^52 + 1, so that doubles hold them and none is 0 or 1.
_DRAWS = 1 << 52


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


Layout = tuple[Shard, ...]


def layout_for(shards: int, regions: int = 2, racks: int = 2, weight: float = 1.0) -> Layout:
    """Shards 0 to shards - 1 of equal weight in so many regions and racks a region, as evenly as they can be."""
    paths = [(f"region{r}", f"rack{r}.{k}") for k in range(racks) for r in range(regions)]
    return tuple(Shard(*paths[s % len(paths)], s, weight) for s in range(shards))


def grown(layout: Layout, weight: float = 1.0) -> Layout:
    """The layout with one more shard, in a region of its own."""
    new = max((s.shard for s in layout), default=-1) + 1
    return (*layout, Shard(f"region+{new}", f"rack+{new}", new, weight))


def _levels(layout: Layout) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level the children (name, weight) of each node; names are paths from the top."""
    if not layout or any(not s.weight > 0 for s in layout) or len({s.shard for s in layout}) < len(layout):
        raise ValueError("a layout needs shards of different numbers and weights above 0")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in layout:
        path = ["", f"{s.region}", f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for depth in range(3):
            node = levels[depth].setdefault(path[depth], {})
            node[path[depth + 1]] = node.get(path[depth + 1], 0.0) + s.weight
    return [{node: sorted(children.items()) for node, children in level.items()} for level in levels]


def _drawn(key: Column, children: Column) -> Column:
    """The child with the least draw; ties, which hashes of 52 bits hardly have, go to the first name."""
    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 12).cast("double") + 1) / (_DRAWS + 1)
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def shard_of(key: Column, layout: Layout) -> Column:
    """The shard of a key, as an integer: one draw among a node's children on each of three levels."""
    numbers = {f"{s.region}/{s.rack}/{s.shard}": s.shard for s in layout}
    held = lambda kids: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in kids])
    at = None
    for level in _levels(layout):
        if at is None:
            at = _drawn(key, held(level[""]))
        else:
            table = F.create_map(*[x for node, kids in sorted(level.items()) for x in (F.lit(node), held(kids))])
            at = _drawn(key, F.element_at(table, at))
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(numbers.items()) for x in pair]), at)


def place(docs: DataFrame, layout: Layout, more: Layout | None = None) -> DataFrame:
    """`doc` (the row of docs), shard, and grown_shard where `more` is given: row by row, nothing is moved."""
    key = F.col("doc.doc_id").cast("long")
    other = shard_of(key, more) if more else F.lit(None).cast("int")
    return docs.select(F.struct("*").alias("doc")).select("doc", shard_of(key, layout).alias("shard"), other.alias("grown_shard"))


def write_shards(docs: DataFrame, layout: Layout, more: Layout | None = None, folder: str | None = None) -> str:
    """Write docs as Parquet, a folder `_shard=N` a shard, and return where; read_shards() reads it."""
    spark = docs.sparkSession
    told = place(docs, layout, more).select("doc", F.col("shard").alias("_shard"), "grown_shard", F.xxhash64(F.col("doc.doc_id").cast("long")).alias("order"), F.monotonically_increasing_id().alias("arrival"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = told.repartitionByRange(parts, "_shard", "order", "arrival").sortWithinPartitions("_shard", "order", "arrival")
    numbered = dealt.select("doc", "grown_shard", "_shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    if folder is None:
        return stash_at(numbered, "shards", "_shard")
    numbered.write.partitionBy("_shard").parquet(folder)
    return folder


def read_shards(docs_like: DataFrame, folder: str) -> DataFrame:
    """What write_shards() has written: `doc` (the row), shard, grown_shard and slot."""
    spark = docs_like.sparkSession
    schema = T.StructType().add("doc", docs_like.schema).add("grown_shard", "integer").add("part", "integer").add("at", "long").add("_shard", "integer")
    rows = spark.read.schema(schema).parquet(folder)
    counts = rows.groupBy("_shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.struct("_shard", "part").alias("run"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    told = keyed_join(rows.withColumn("run", F.struct("_shard", "part")), starts, "run", counts.count())
    return told.select("doc", F.col("_shard").alias("shard"), "grown_shard", (F.col("at") + F.col("shift")).alias("slot"))


def digests(docs: DataFrame, layout: Layout, more: Layout) -> DataFrame:
    """Size, crc, law, shard and slot of every row, read back from the written shards."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("doc.text", F.lit(""))
    read = read_shards(slim, write_shards(slim, layout, more))
    return read.select(F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
