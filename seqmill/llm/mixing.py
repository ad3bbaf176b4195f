"""Temperature mixing of sources, with DataFrame functions alone.

A source with share p of all tokens gets the weight p^t / sum of p^t. The exponent t (0: all
sources alike, 1: as they come) is bisected until the weights reach a target entropy, or until
no source is repeated more than `repetition_limit` times. The weights are realised under a
token budget: a source with e epochs is read in floor(e) whole passes, each in a pseudo-random
order of its own, and in one part of a further pass, cut where its tokens reach the budget.
All passes are dealt into blocks that each hold every source in proportion to its weight.

Without a budget, the budget is the least that reads every source whole at least once.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Cases: a null text has no tokens; a null source is a
source of its own; documents without tokens come once in every whole pass; rows that are alike
stay together; ties of shares get the same weight; an empty table gives an empty result; very long
texts are one document like others; docs' columns are handed on whatever their names, but for a
column __mix, which the result's own one replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed_join, stash

PROBES = 15
_WORD = r"[^\x20\x09-\x0D]+"
#: The null source's name inside; a source whose name begins with it gets it once more.
_NONE = "\0"


@dataclass(frozen=True)
class Mix:
    """repetition_limit: most passes over any source; target_entropy: of the weights, in nats; budget: tokens to emit, None for the least that drops nothing."""

    repetition_limit: float | None = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    blocks: int = 64
    seed: int = 0


def _source(c: str) -> Column:
    name = F.col(c).cast("string")
    return F.when(name.isNull(), _NONE).when(name.startswith(_NONE), F.concat(F.lit(_NONE), name)).otherwise(name)


def _place(mix: Mix) -> Column:
    return F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("text"))


def slim_table(docs: DataFrame, mix: Mix, source: str = "source") -> DataFrame:
    """The source, tokens and place (a hash that orders a source's rows) of every document, written."""
    rows = docs.select(_source(source).alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long").alias("tokens"), _place(mix).alias("place"))
    return stash(rows, "tokens")


def _entropies(sources: DataFrame, total: int, exponents: list[float]) -> list[float]:
    """The entropy of the weights at each exponent, in one job over the sources."""
    log_p = F.log(F.col("tokens") / F.lit(float(total)))
    sums = [x for i, t in enumerate(exponents) for x in (F.sum(F.exp(log_p * t)).alias(f"z{i}"), F.sum(F.exp(log_p * t) * log_p).alias(f"s{i}"))]
    row = sources.filter("tokens > 0").agg(*sums).first()
    return [math.log(row[f"z{i}"]) - t * row[f"s{i}"] / row[f"z{i}"] for i, t in enumerate(exponents)]


def find_exponent(sources: DataFrame, mix: Mix, rounds: int = 5) -> float:
    """The exponent in 0 to 1 by repeated bisection of its bracket, PROBES points a job.

    Entropy falls and repetition of the smallest source falls as the exponent rises, so either
    target brackets one point; of two targets the larger exponent holds.
    """
    s = sources.filter("tokens > 0").agg(F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not s["total"]:
        return 1.0
    found = 0.0
    if mix.target_entropy is not None:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            points = [low + (high - low) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
            above = [h >= mix.target_entropy for h in _entropies(sources, s["total"], points)]
            low, high = max([low, *(t for t, a in zip(points, above, strict=True) if a)]), min([high, *(t for t, a in zip(points, above, strict=True) if not a)])
        found = (low + high) / 2
    if mix.repetition_limit is not None:

        def repeated(t: float, z: float | None) -> float:
            if mix.budget is None:
                return (s["most"] / s["least"]) ** (1 - t)
            return mix.budget / s["total"] * (s["least"] / s["total"]) ** (t - 1) / z

        low, high = found, 1.0
        if mix.budget is None:
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (low, mid) if repeated(mid, None) <= mix.repetition_limit else (mid, high)
        else:
            log_p = F.log(F.col("tokens") / F.lit(float(s["total"])))
            for _ in range(rounds):
                points = [low + (high - low) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
                row = sources.filter("tokens > 0").agg(*(F.sum(F.exp(log_p * t)).alias(f"z{i}") for i, t in enumerate(points))).first()
                within = [repeated(t, row[f"z{i}"]) <= mix.repetition_limit for i, t in enumerate(points)]
                low, high = max([low, *(t for t, a in zip(points, within, strict=True) if not a)]), min([high, *(t for t, a in zip(points, within, strict=True) if a)])
        found = high if high < 1 or found < 1 else found
    return found


def plan_sources(slim: DataFrame, mix: Mix) -> DataFrame:
    """source, tokens, weight, epochs, passes and cut of every source, written.

    The cut is the last place that the part of a pass still holds. It is found in two steps of
    4096 buckets of the place, each a sum by source and bucket, and row by row only inside one
    bucket of the second step: no source is ever ordered whole.
    """
    place = F.col("place")
    first = stash(slim.groupBy("source", F.shiftright(place, 52).alias("b1")).agg(F.sum("tokens").alias("tokens")), "buckets")
    sources = stash(first.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    t = find_exponent(sources, mix)
    s = sources.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most")).first()
    total, most = float(s["total"] or 0), float(s["most"] or 0)
    share = F.col("tokens") / F.lit(total or 1.0)
    powered = F.when(F.col("tokens") > 0, F.pow(share, F.lit(t))).otherwise(0.0)
    z = sources.agg(F.sum(powered).alias("z")).first()["z"] or 1.0
    budget = float(mix.budget) if mix.budget is not None else (most * z / (most / total) ** t if total else 0.0)
    planned = sources.withColumn("weight", powered / F.lit(z))
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(1.0))
    planned = planned.withColumn("passes", F.floor(F.col("epochs") + 1e-9).cast("int"))
    planned = planned.withColumn("rest", F.floor(F.greatest(F.col("epochs") - F.col("passes"), F.lit(0.0)) * F.col("tokens") + 1e-6).cast("long"))

    def boundary(sums: DataFrame, bucket: str) -> DataFrame:
        """Of each source with a rest, the first bucket whose running sum exceeds it, and what is left for it."""
        running = Window.partitionBy("source").orderBy(bucket)
        summed = sums.withColumn("upto", F.sum("tokens").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        hit = summed.filter(F.col("upto") > F.col("rest"))
        return hit.groupBy("source").agg(F.min_by(F.struct(F.col(bucket), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), bucket).alias("hit")).select("source", f"hit.{bucket}", F.col("hit.left").alias("rest"))

    planned = stash(planned, "epochs")
    n = planned.count()
    b1 = stash(boundary(keyed_join(first, planned.filter("rest > 0").select("source", "rest"), "source", n), "b1"), "cut1")
    inside = keyed_join(slim, b1.withColumnRenamed("b1", "want"), "source", n).filter(F.shiftright(place, 52) == F.col("want"))
    inside = stash(inside.select("source", "tokens", "place", "rest", F.col("want").alias("b1")), "inside")
    second = inside.groupBy("source", "b1", "rest", F.shiftright(place, 40).alias("b2")).agg(F.sum("tokens").alias("tokens"))
    b2 = stash(boundary(second, "b2"), "cut2")
    last = keyed_join(inside.drop("rest"), b2.withColumnRenamed("b2", "want"), "source", n).filter(F.shiftright(place, 40) == F.col("want"))
    running = Window.partitionBy("source", "want").orderBy("place")
    last = last.withColumn("upto", F.sum("tokens").over(running)).groupBy("source", "want").agg(F.max(F.when(F.col("upto") <= F.col("rest"), place)).alias("held"))
    cuts = last.select("source", F.coalesce("held", F.shiftleft("want", 40) - 1).alias("cut"))
    plan = planned.join(cuts, "source", "left").select("source", "tokens", "weight", "epochs", "passes", "cut")
    return stash(plan, "plan")


def realise(docs: DataFrame, plan: DataFrame, mix: Mix, source: str = "source") -> DataFrame:
    """docs, each row once for each pass that holds it, with the struct __mix: weight, pass, block, order.

    block and order put the passes of all sources together; sorting by them gives the mixture.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != "__mix"]
    placed = docs.select(F.struct(*names).alias("doc"), _source(source).alias("source"), _place(mix).alias("place"))
    small = plan.select("source", F.struct("weight", "epochs", "passes", "cut").alias("plan"))
    joined = keyed_join(placed, small, "source", plan.count())
    plan_, place = F.col("plan"), F.col("place")
    last = F.when(place <= plan_["cut"], plan_["passes"]).otherwise(plan_["passes"] - 1)
    passes = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = joined.withColumn("pass", F.explode(passes))
    unit = F.pmod(F.xxhash64(F.lit(mix.seed), "pass", "place"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    size = F.least(F.lit(1.0), plan_["epochs"] - F.col("pass"))
    at = F.least((F.col("pass") + unit * size) / plan_["epochs"], F.lit(1.0))
    block = F.least(F.floor(at * mix.blocks), F.lit(mix.blocks - 1)).cast("int")
    made = F.struct(plan_["weight"].alias("weight"), F.col("pass").alias("pass"), block.alias("block"), F.xxhash64(F.lit(mix.seed), block, "pass", "place").alias("order"))
    return rows.select("doc", made.alias("__mix")).select("doc.*", "__mix")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """The mixture of docs: see realise()."""
    return realise(docs, plan_sources(slim_table(docs, mix, source), mix), mix, source)


def in_order(mixed: DataFrame, blocks: int) -> DataFrame:
    """The mixture with its rows in place: one task, hence one file, a block, sorted inside; without __mix.

    Blocks hold all sources in proportion and are alike in size, so they are dealt by their number.
    """
    dealt = mixed.repartitionById(blocks, F.col("__mix.block")).sortWithinPartitions("__mix.order", "__mix.pass")
    return dealt.drop("__mix")
