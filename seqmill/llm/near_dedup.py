"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Each set has `PERMUTATIONS` minwise tokens.
Independent trees branch the documents: a node's members go to a child for each value of a few
minwise tokens that the node chooses, so similar sets keep meeting. A node of at most
`LEAF` members is compared exhaustively by sketches of one byte a token, and larger ones branch
again. Whatever a sketch puts at `NEAR` or more is confirmed on full sets, until every such pair
is either decided or lies within one component already.

The number of trees follows from `target_recall`: with r of them, a pair at similarity 0.75 meets at
a root with probability 1 - 0.25^r, and pairs that are more alike do more often. NEAR is 3.3 standard
deviations of a sketch below 0.75. In a node of over `LEAF` members some members are pivots: the least id
and a few by hash, other ones in every node. All members are compared with them by sketch, each proposes the
least pivot of another label that it is NEAR, and of two labels at most two proposals are confirmed on full sets. Confirmed links join
labels, which hold in all nodes: a node of one label ends, one with few pairs of different labels becomes leaves at
once, however large it is, and only the others branch. What `LEVELS` levels leave is compared exhaustively block
by block, each member with all of other labels. So no group of copies is cut or left out, and a group whose members are
linked with its pivots does not branch at all.

What keeps this linear: equal sets are one member; nodes with equal members are worked on once, whether
small or large; members of one label are not compared; one node returns a spanning forest of its labels, never all of its
pairs; pairs meet their sets in joins that deal a set out to as many tasks as it has thousands of pairs.

Cases: texts without words (null, empty) have an empty set and are linked with nothing; of
fewer than five words the whole sequence is the one shingle; a null doc_id is a document of
its own below all others, with null as its component_id; rows with one doc_id are one document,
whose links are those of all its texts (together with ids over 2^62 that is an error, as ids for
the further texts are made above the largest one); repeated rows are one text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column, keyed_join, stash, text_slices
from .components import components
from .words import mixed, split_words, vocab_hashes, windows

SHINGLE = 5
PERMUTATIONS = 256
#: At 0.75; twelve trees.
TARGET_RECALL = 1 - 1e-7
LEAF = 1500
#: Pivots of a large node, and how often large nodes branch before they are compared block by block.
PIVOTS, LEVELS = 4, 8
NEAR = 0.66
#: Pairs of one set that a task confirms.
PAIRS_A_TASK = 1000
_LOWEST = -(2**63)

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def trees_for(target_recall: float) -> int:
    """How many trees find a pair at similarity 0.75 with that probability."""
    return max(1, min(PERMUTATIONS, math.ceil(math.log(max(1 - target_recall, 1e-15)) / math.log(0.25) - 1e-9)))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text without nulls."""
    w = split_words(texts, lower=True)
    keys = vocab_hashes(w.vocab)[w.codes] if len(w.codes) else np.empty(0, np.uint64)
    hashes, begin = windows(keys, w.parent, SHINGLE)
    owner, counts = w.parent[begin], w.counts
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    first = np.searchsorted(w.parent, np.arange(len(texts)))
    sets = []
    for i, n in enumerate(counts.tolist()):
        if n >= SHINGLE:
            sets.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif n:
            h = np.full(1, n, np.uint64)
            for k in keys[first[i] : first[i] + n]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + k)
            sets.append(h)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, a row of PERMUTATIONS for each."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MULTIPLY[k], starts)
    return out


def _signer(trees: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for at, n in text_slices(texts, 1 << 20):
                sets = shingle_sets(texts.slice(at, n))
                held = [s for s in sets if len(s)]
                tokens = iter(minwise(held) if held else ())
                sizes, digests, roots, sketches = [], [], [], []
                for s in sets:
                    sizes.append(len(s))
                    t = next(tokens) if len(s) else None
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    roots.append(t[:trees].tobytes() if t is not None else None)
                    sketches.append((t * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes() if t is not None else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(roots, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n_shingles", "digest", "roots", "sketch"])

    return signed


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """id, n_shingles, digest of the set, its minwise tokens for the roots and its sketch, for every row."""
    slim = bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_signer(trees), "id bigint, n_shingles bigint, digest binary, roots binary, sketch binary")


def _sized(rows: DataFrame) -> DataFrame:
    """node, n, members (a hash of them), low and high label, and pivots of the nodes of rows with more than one label."""
    picks = [F.min("id"), *(F.min_by("id", F.xxhash64(F.lit(k), "node", "id")) for k in range(1, PIVOTS))]
    return rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"), F.array(*picks).alias("pivots")).filter("n > 1 and low <> high")


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with their large nodes, and for each the pivot that the member proposes to: of those of other labels that it
    is NEAR the least one at 0.75 or more, else the least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        at = get("at")
        member = pc.list_parent_indices(at).to_numpy(zero_copy_only=False).astype(np.int64)
        nodes, heads = at.flatten().field("node"), at.flatten().field("heads")
        place, flat = pc.list_parent_indices(heads).to_numpy(zero_copy_only=False).astype(np.int64), heads.flatten()
        owner = member[place]
        own, theirs = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for x in (get("sketch"), flat.field("sketch")))
        labels, (pivot, other) = get("label").to_numpy(), (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pivot", "label"))
        same = (own[owner] == theirs).mean(1)
        near = np.flatnonzero((same >= NEAR) & (labels[owner] != other))
        near = near[np.lexsort((pivot[near], same[near] < 0.75, place[near]))]
        near = near[np.diff(place[near], prepend=-1) != 0]
        told = np.zeros(len(nodes), bool)
        told[place[near]] = True
        values = [np.zeros(len(nodes), t) for t in (np.int64, np.int64, np.float64)]
        for v, x in zip(values, (pivot, other, same), strict=True):
            v[place[near]] = x[near]
        flat_at = pa.StructArray.from_arrays([nodes, *(pa.array(v, mask=~told) for v in values)], ["node", "pivot", "pivot_label", "same"])
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(member, minlength=batch.num_rows))]), pa.int32())
        yield pa.RecordBatch.from_arrays([get("id"), get("label"), get("sketch"), pa.ListArray.from_arrays(bounds, flat_at)], names=["id", "label", "sketch", "at"])


def _distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes with equal members one."""
    return nodes.groupBy("n", "members").agg(F.min_by(F.struct("node", "pivots"), "node").alias("kept")).select("n", "kept.*")


class Links:
    """Confirmed links (u, v) of a join, the labels that they join, and the full sets that confirming has needed."""

    def __init__(self, texts: DataFrame, told: DataFrame | None = None) -> None:
        """texts: id, text. told: doc, digest and id of the texts of documents with several; texts have the doc's id there."""
        self.texts, self.told = texts, told
        self.sets: list[DataFrame] = []
        self.linked: list[DataFrame] = []
        self.n = self.n_labels = 0
        self.labels: DataFrame | None = None

    def label(self, rows: DataFrame, name: str = "label") -> DataFrame:
        """rows with the label of each id: the least id that links so far reach."""
        if self.labels is None:
            return rows.withColumn(name, F.col("id"))
        labels = self.labels.select("id", F.col("component").alias("_label"))
        return keyed_join(rows, labels, "id", self.n_labels, "left").withColumn(name, F.coalesce("_label", "id")).drop("_label")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """id, set of at least the ids in wanted; sets that are there already are not made again."""
        for held in self.sets:
            wanted = wanted.join(held.select("id"), "id", "left_anti")
        wanted = stash(wanted.distinct(), "wanted")
        if wanted.limit(1).count():
            self.sets.append(stash(self._made(wanted), "sets"))
        return reduce(DataFrame.union, self.sets) if self.sets else self.texts.sparkSession.createDataFrame([], "id bigint, set binary")

    def _made(self, wanted: DataFrame) -> DataFrame:
        made = lambda ids: keyed_join(self.texts, ids, "id", ids.count()).mapInArrow(_sets_of, "id bigint, set binary, digest binary")
        if self.told is None:
            return made(wanted).select("id", "set")
        of = stash(wanted.join(self.told, "id"), "texts")
        several = made(stash(of.select(F.col("doc").alias("id")).distinct(), "docs")).withColumnRenamed("id", "doc")
        plain = made(stash(wanted.join(self.told.select("id"), "id", "left_anti"), "plain")).select("id", "set")
        return plain.union(several.join(of, ["doc", "digest"]).select("id", "set").dropDuplicates(["id"]))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Written: a, b, linked of the distinct pairs (a, b); labels are joined by the linked ones."""
        pairs = stash(pairs.select("a", "b").distinct(), "pairs")
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        both = _with_sets(_with_sets(pairs, sets, "a"), sets, "b")
        decided = stash(both.mapInArrow(_confirmed, "a bigint, b bigint, linked boolean"), "decided")
        self.add(decided.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), decided.count())
        return decided

    def add(self, linked: DataFrame, n: int) -> None:
        self.linked, self.n = [*self.linked, linked], self.n + n
        self.labels = stash(components(reduce(DataFrame.union, self.linked), self.n), "labels")
        self.n_labels = self.labels.count()


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """pairs with the set of one side; a set with many pairs is dealt out to a task for each PAIRS_A_TASK of them."""
    many = stash(pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("tasks")).filter("tasks > 1"), "many")
    n = many.count()
    sets = sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
    tasks = F.coalesce("tasks", F.lit(1))
    dealt = keyed_join(pairs, many, side, n, "left").withColumn("task", F.pmod(F.xxhash64("a", "b"), tasks).cast("int")).drop("tasks")
    copies = keyed_join(sets, many, side, n, "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    return dealt.join(copies, [side, "task"]).drop("task")


def chosen_paths(members: DataFrame, trees: int, links: Links) -> DataFrame:
    """id and its leaf nodes; large nodes add to links on the way.

    A member is one row with all of its nodes, so that it meets its label and its sketch once a level.
    """
    roots = [F.xxhash64(F.lit(i), F.substring("roots", 4 * i + 1, 4)) for i in range(trees)]
    rows = stash(members.select("id", F.array(*roots).alias("nodes")), "roots")
    sketched = members.select("id", "sketch")
    leaves: list[DataFrame] = []
    for level in range(LEVELS + 1):
        nodes = stash(_sized(links.label(rows).select("id", "label", F.explode("nodes").alias("node"))), "nodes")
        small = stash(_distinct_nodes(nodes.filter(F.col("n") <= LEAF)).select("node"), "small")
        flat = rows.select("id", F.explode("nodes").alias("node"))
        leaves.append(keyed_join(flat, small, "node", small.count()).select("node", "id"))
        large = stash(_distinct_nodes(nodes.filter(F.col("n") > LEAF)), "large")
        count = large.count()
        if not count:
            break
        inside = stash(_compared_with_pivots(flat, large, count, sketched, links), "inside")
        two = [F.least("label", "pivot_label"), F.greatest("label", "pivot_label")]
        pair = F.struct(F.col("pivot").alias("a"), F.col("id").alias("b"))
        proposed = inside.select("id", "label", F.inline("at")).filter("pivot is not null").groupBy(*two).agg(F.array(F.max_by(pair, F.struct("same", "id")), F.min(pair)).alias("pairs"))
        links.confirm(proposed.select(F.inline("pairs")))
        told = stash(links.label(inside.select("id", F.col("at.node").alias("nodes"))).select("id", "label", F.explode("nodes").alias("node")), "told")
        large, dominated, kept = _told_by_labels(told)
        n_dominated = dominated.count()
        if n_dominated:
            leaves.append(_leaves_beside(told, dominated, n_dominated))
        if not kept:
            break
        going_on = keyed_join(told.select("id", "node"), large.select("node", "n"), "node", kept)
        if level == LEVELS:
            leaves.append(_blocks(going_on))
            break
        # two levels at a time, each node choosing two or three pairs of tokens, told apart by their sketch bytes
        picks = F.sequence(F.lit(0), F.when(F.pmod(F.xxhash64("node"), F.lit(4)) == 0, 2).otherwise(1))
        chosen = going_on.select("id", "node", F.explode(picks).alias("pick"))
        choices = [(F.pmod(F.xxhash64(F.lit(k), "node", "pick"), F.lit(PERMUTATIONS)).cast("int") + 1).alias(f"at{k}") for k in (1, 2)]
        chosen = chosen.groupBy("id").agg(F.collect_list(F.struct("node", "pick", *choices)).alias("picks")).join(sketched, "id")
        child = lambda c: F.xxhash64(c["node"], c["pick"], *(F.substring("sketch", c[f"at{k}"], F.lit(1)) for k in (1, 2)))
        rows = stash(chosen.select("id", F.transform("picks", child).alias("nodes")), "paths")
    return stash(reduce(DataFrame.union, leaves).groupBy("id").agg(F.collect_list("node").alias("nodes")), "leaves")


def _compared_with_pivots(flat: DataFrame, large: DataFrame, count: int, sketched: DataFrame, links: Links) -> DataFrame:
    wanted = stash(large.select("node", F.explode(F.array_distinct("pivots")).alias("id")), "wanted")
    heads = links.label(keyed_join(sketched, wanted.select("id").distinct(), "id", PIVOTS * count))
    heads = wanted.join(heads, "id").groupBy("node").agg(F.collect_list(F.struct(F.col("id").alias("pivot"), "label", "sketch")).alias("heads"))
    found = keyed_join(flat, stash(heads, "pivots"), "node", count, limit=20_000)
    met = links.label(found.groupBy("id").agg(F.collect_list(F.struct("node", "heads")).alias("at")).join(sketched, "id"))
    return bounded(met.select("id", "label", "sketch", "at")).mapInArrow(_proposals, "id bigint, label bigint, sketch binary, at array<struct<node: bigint, pivot: bigint, pivot_label: bigint, same: double>>")


def _told_by_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of nodes with several labels those that go on, those with at most as many pairs across labels as a leaf, and how many go on."""
    parts = rows.groupBy("node", "label").agg(F.count("*").alias("k"))
    nodes = parts.groupBy("node").agg(F.sum("k").alias("n"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"), F.max_by("label", "k").alias("major")).filter("n * cast(n as double) > squares")
    nodes = stash(nodes.withColumn("few", F.col("n").cast("double") * F.col("n") - F.col("squares") <= float(LEAF) * LEAF), "told")
    return nodes.filter("not few"), nodes.filter("few"), nodes.filter("not few").count()


def _leaves_beside(rows: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Leaves that hold a part of a node's largest label and all of its other labels, which are few."""
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    held = keyed_join(rows, nodes.select("node", "major", blocks.alias("blocks")), "node", count)
    own = F.when(F.col("label") == F.col("major"), F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return held.select("id", "node", F.explode(own).alias("block")).select(F.xxhash64(F.lit("beside"), "node", "block").alias("node"), "id")


def _blocks(rows: DataFrame) -> DataFrame:
    """Leaves that hold each two blocks of a node's members."""
    half = max(1, LEAF // 2)
    held = rows.withColumn("blocks", F.ceil(F.col("n") / half).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = held.select("id", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return pairs.select(F.xxhash64(F.lit("blocks"), "node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id")


def _by_node(rows: DataFrame) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "node").sortWithinPartitions("node", "id")


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes from batches that are sorted by node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(nodes, nodes[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != nodes[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(nodes: np.ndarray, sketches: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, likeness) of rows in one node whose sketches are NEAR, and, if given, of different `apart`."""
    out_i, out_j, out_s = [], [], []
    left, lag = np.arange(len(nodes)), 1
    need = NEAR * PERMUTATIONS
    while True:
        left = left[left + lag < len(nodes)]
        left = left[nodes[left] == nodes[left + lag]]
        if not len(left):
            break
        at = left if apart is None else left[apart[left] != apart[left + lag]]
        for begin in range(0, len(at), 4096):
            i = at[begin : begin + 4096]
            same = np.count_nonzero(sketches[i] == sketches[i + lag], axis=1)
            hit = same >= need
            out_i.append(i[hit])
            out_j.append(i[hit] + lag)
            out_s.append(same[hit])
        lag += 1
    if not out_i:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_s)


class Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node, the spanning forest of its labels by NEAR pairs, the most alike first."""
    for table in _whole_nodes(batches):
        nodes, ids, labels = (table.column(c).to_numpy() for c in ("node", "id", "component"))
        i, j, same = _near_pairs(nodes, _sketches(table), labels)
        order = np.argsort(-same, kind="stable")
        i, j = i[order], j[order]
        trees, held = Union(), []
        for x, y, node, u, v in zip(i.tolist(), j.tolist(), nodes[i].tolist(), labels[i].tolist(), labels[j].tolist(), strict=True):
            if trees.join((node, u), (node, v)):
                held.append((x, y))
        if held:
            x, y = np.array(held).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, id, component of members with a NEAR partner in another component."""
    for table in _whole_nodes(batches):
        nodes, comps = table.column("node").to_numpy(), table.column("component").to_numpy()
        i, j, _ = _near_pairs(nodes, _sketches(table), comps)
        rows = np.unique(np.concatenate([i, j]))
        yield from table.select(["node", "id", "component"]).take(rows).to_batches()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.75 or more."""
    if min(len(a), len(b)) * 100 < 75 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(get("set_a"), get("set_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([get("a"), get("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])


def _links_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node, links between components, confirmed on full sets, as a forest of components."""
    for table in _whole_nodes(batches):
        nodes, comps = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set")]
        i, j, same = _near_pairs(nodes, _sketches(table), comps)
        order, joined, out = np.argsort(-same, kind="stable"), Union(), []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            a, b = int(comps[x]), int(comps[y])
            if joined.root(a) != joined.root(b) and similar(sets[x], sets[y]):
                joined.join(a, b)
                out.append((a, b))
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        for at, n in text_slices(texts, 1 << 20):
            sets = [s.tobytes() for s in shingle_sets(texts.slice(at, n))]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sets, pa.binary()), pa.array(digests, pa.binary())], names=["id", "set", "digest"])


def _told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """signed with `doc` (its id) and an `id` for each text, and the docs of several rows, if there are any.

    The text with the least digest keeps the doc's id, the others get ids above all docs.
    """
    several = stash(signed.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.count("*").alias("n")).filter("n > 1"), "several")
    n = several.count()
    if not n:
        return signed.withColumn("doc", F.col("id")), None
    top = signed.agg(F.max("id")).first()[0]
    texts = keyed_join(signed, several.filter("least <> most").select("id", "least"), "id", n).filter("digest <> least").select("id", "digest").distinct()
    texts = stash(texts, "texts")
    if top > 1 << 62 and texts.limit(1).count():
        raise ValueError("no room above the largest doc_id for further texts of repeated ids")
    new = stash(texts.withColumn("made", F.lit(top + 1) + F.monotonically_increasing_id()), "new")
    told = signed.join(new, ["id", "digest"], "left")
    return told.withColumn("doc", F.col("id")).withColumn("id", F.coalesce("made", "id")).drop("made"), several.select(F.col("id").alias("doc"))


def find_components(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    trees = trees_for(target_recall)
    signed, several = _told_apart(stash(signatures(docs, trees), "signatures"))
    digests = signed.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = stash(digests.filter("n > 1").select("digest", "first"), "repeated")
    n_repeated = repeated.count()
    placed = keyed_join(signed, repeated, "digest", n_repeated, "left").withColumn("first", F.coalesce("first", "id"))
    members = placed.filter("digest is not null and id = first").select("id", "roots", "sketch")
    members = stash(members.dropDuplicates(["id"]) if several is not None else members, "members")

    texts = bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.col("text").cast("string").alias("text"))
    told = None if several is None else stash(keyed_join(placed, several, "doc", several.count()).filter("digest is not null").select("doc", "digest", "id").distinct(), "told")
    links = Links(texts, told)
    leaves = chosen_paths(members, trees, links)
    sketched = members.select("id", "sketch")
    in_nodes = lambda rows: rows.join(sketched, "id").select(F.explode("nodes").alias("node"), "id", "component", "sketch")
    decided = links.confirm(_by_node(in_nodes(links.label(leaves, "component"))).mapInArrow(_forests, "a bigint, b bigint"))
    if several is not None:  # the texts of one document hang together
        own = stash(keyed_join(placed, several, "doc", several.count()).select(F.col("doc").alias("u"), F.col("first").alias("v")).distinct(), "same")
        links.add(own, own.count())

    # A refused pair may have stood for others of its node: compare its components' members anew.
    refused = decided.filter("not linked").select("a", "b")
    ends = links.label(refused.withColumnRenamed("a", "id"), "u").drop("id").withColumnRenamed("b", "id")
    ends = links.label(ends, "v").filter("u <> v")
    dirty = stash(ends.select(F.explode(F.array("u", "v")).alias("component")).distinct(), "dirty")
    n_dirty = dirty.count()
    if n_dirty:
        again = keyed_join(links.label(leaves, "component"), dirty, "component", n_dirty)
        involved = stash(_by_node(in_nodes(again)).mapInArrow(_involved, "node bigint, id bigint, component bigint"), "involved")
        sets = links.sets_of(involved.select("id"))
        held = involved.join(sketched, "id").join(sets, "id").select("node", "id", "component", "sketch", "set")
        across = stash(_by_node(held).mapInArrow(_links_across, "u bigint, v bigint"), "across")
        links.add(across, across.count())
    final = links.labels.select(F.col("id"), "component")
    final = stash(final, "components").select(F.col("id").alias("first"), "component")
    result = keyed_join(placed.select("doc", "n_shingles", "first"), final, "first", final.count(), "left")
    component = F.coalesce("component", "first")
    shown = lambda c: F.when(c != _LOWEST, c)
    return result.select(shown(F.col("doc")).alias("doc_id"), "n_shingles", shown(component).alias("component_id"), (F.col("doc") == component).alias("kept"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, with docs' columns."""
    found = stash(find_components(docs), "classes")
    gone = found.filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return keyed_join(keyed, gone, "id", gone.count(), "left_anti").select("doc.*")
