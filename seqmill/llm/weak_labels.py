"""A document classifier from weak labels.

Heuristic labellers fire or stay silent on every document; given labels, where there are any,
are one more labeller. One labeller looks for telling words: words that the labelled documents of a bounded
sample have in bad ones far more often than chance. They are learned in two halves, by a hash of doc_id, and while
the labellers are weighed a document is asked for the words of the half that it is not in, so that no label
speaks for itself. Expectation-maximisation over the counts of their joint patterns
estimates how often each fires on bad and on good documents, and with that the posterior of
every pattern. A linear scorer over hashed words and word beginnings is then trained on the
posteriors of a bounded sample of labelled documents, and scores all documents.

Bad means junk or abuse. Cases: a null or empty text has no words, so no labeller fires and
the score is that of the bias; labels without a document count for nothing, of repeated labels
the worst holds, null labels are no labels; rows with one doc_id are scored one by one, and the least
of their texts teaches; documents with a null doc_id have no label; ties of the sample's hash are cut
by doc_id; without any label the posteriors come from the labellers alone, and the scorer is trained
on a sample of all documents and no word tells; very long texts are read whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, column, stash, text_slices
from .words import Words, mixed, split_words, vocab_hashes, windows

LABELLERS = ("repeats", "symbols", "shouting", "telling", "monotony")
SLOTS = 1 << 18
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5)
_TRIMMED = ".,;:!?\"'()"
#: Telling words: at most so many in both halves, of at most so many characters, in at least so many labelled texts, of which
#: a share of at least so much is bad, and by so many standard deviations more than chance has it.
TELLING_WORDS, TELLING_LENGTH, TELLING_TEXTS, TELLING_SHARE, TELLING_DEVIATIONS = 4096, 64, 5, 0.97, 5.0


def _share(flags: np.ndarray, w: Words) -> np.ndarray:
    """The share of a text's words that are flagged in the vocabulary."""
    return np.bincount(w.parent, weights=flags[w.codes].astype(float), minlength=w.n_texts) / np.maximum(w.counts, 1)


def _bare(w: Words) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(w.vocab), _TRIMMED)


def fired(w: Words, telling: tuple[list[str], list[str]], half: np.ndarray | None = None) -> np.ndarray:
    """A bit for each labeller of LABELLERS that fires on a text.

    telling: the words that each half of the labelled texts tells of. With half, the half of each
    text, the words of the other half are looked for, without it those of both.
    """
    if not len(w.codes):
        return np.zeros(w.n_texts, np.int64)
    flags = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    hashes, begin = windows(mixed(w.codes.astype(np.uint64) + np.uint64(1)), w.parent, 5)
    _, where, times = np.unique(hashes ^ mixed(w.parent[begin].astype(np.uint64) + np.uint64(1 << 40)), return_inverse=True, return_counts=True)
    again = np.bincount(w.parent[begin[times[where] > 1]], minlength=w.n_texts) / np.maximum(w.counts, 1)
    symbols = _share(flags(pc.match_substring_regex(w.vocab, "[#*$%&|<>]")), w)
    upper = pc.and_(pc.utf8_is_upper(w.vocab), pc.greater(pc.utf8_length(w.vocab), 1))
    shouting = _share(flags(upper) | flags(pc.match_substring(w.vocab, "!!")), w)
    bare = _bare(w)
    tells = np.stack([flags(pc.is_in(bare, pa.array(words, bare.type))) for words in telling])
    hits = tells.any(axis=0)[w.codes] if half is None else tells[1 - half[w.parent], w.codes]
    told = np.bincount(w.parent[hits], minlength=w.n_texts)
    kinds = len(w.vocab)
    distinct = np.bincount(np.unique(w.parent * kinds + w.codes) // kinds, minlength=w.n_texts) / np.maximum(w.counts, 1)
    votes = (again > 0.2, symbols > 0.15, shouting > 0.3, told > 0, (distinct < 0.2) & (w.counts >= 20))
    return sum(v.astype(np.int64) << i for i, v in enumerate(votes))


def features(w: Words, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of all distinct hashed features, sorted by text; a labeller's slot is its place."""
    if not len(w.codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by, labeller = np.nonzero(votes[:, None] >> np.arange(len(LABELLERS)) & 1)
    bare = _bare(w)
    views = [vocab_hashes(bare), *(vocab_hashes(pc.utf8_slice_codeunits(bare, 0, n)) + np.uint64(n) for n in BEGINNINGS)]
    slots = np.stack([(mixed(v) % np.uint64(SLOTS)).astype(np.int64) for v in views], axis=1)
    kinds = len(w.vocab)
    pairs = np.unique(w.parent * kinds + w.codes)
    text, code = pairs // kinds, pairs % kinds
    both = np.unique(np.concatenate([((text[:, None] << 18) | slots[code]).ravel(), by << 18 | labeller]))
    return both >> 18, both & (SLOTS - 1)


# ---- labellers


@dataclass
class LabelModel:
    """prior of bad; for each labeller its rates of firing on (good, bad); the given labels' accuracy on each."""

    prior: float
    rates: np.ndarray
    given: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """P(bad) of vote bits, and of given labels: 1 bad, 0 good, -1 none."""
        total = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for i, (good, bad) in enumerate(self.rates):
            on = (votes >> i & 1).astype(bool)
            total += np.where(on, math.log(bad / good), math.log((1 - bad) / (1 - good)))
        if given is not None:
            total += np.where(given == 1, math.log(self.given[1] / (1 - self.given[0])), 0) + np.where(given == 0, math.log((1 - self.given[1]) / self.given[0]), 0)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def weights(self) -> tuple[np.ndarray, float]:
        """A weight for each labeller and a bias, so that their sum is the log-odds of the posterior of votes."""
        on, off = np.log(self.rates[:, 1] / self.rates[:, 0]), np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        return on - off, math.log(self.prior / (1 - self.prior)) + float(off.sum())


def fit_labellers(votes: np.ndarray, given: np.ndarray, counts: np.ndarray, rounds: int = 100, trust: float = 100, unlabelled: float = 0.1) -> LabelModel:
    """Expectation-maximisation over patterns (votes, given) and their counts.

    Given labels start as right 19 times in 20, which counts as much as `trust` documents; beyond
    that their accuracy is what the labellers say of them. Where labels are given, a document without one counts
    `unlabelled`, so that kinds of bad documents that few labellers know are not taken for good ones.
    """
    model = LabelModel(0.2, np.array([[0.01, 0.3]] * len(LABELLERS)), np.array([0.95, 0.9]))
    if not counts.sum():
        return model
    if (given >= 0).any():
        counts = np.where(given < 0, unlabelled * counts, counts)
    keep = lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    for _ in range(rounds):
        bad = model.posterior(votes, given) * counts
        good = counts - bad
        on = (votes[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
        rates = np.stack([(good @ on + 0.1) / (good.sum() + 10), (bad @ on + 1) / (bad.sum() + 5)], axis=1)
        known = [(given == 0) @ good, (given >= 0) @ good, (given == 1) @ bad, (given >= 0) @ bad]
        accuracy = np.array([(known[0] + 0.95 * trust) / (known[1] + trust), (known[2] + 0.95 * trust) / (known[3] + trust)])
        model = LabelModel(float(keep((bad.sum() + 1) / (counts.sum() + 5))), keep(rates), keep(accuracy))
    return model


# ---- scorer


def train_scorer(texts: list[np.ndarray], target: np.ndarray, model: LabelModel, epochs: int = 12, rate: float = 0.08, least_steps: int = 2000, least_texts: int = 20, decay: float = 5e-3) -> np.ndarray:
    """Weights of SLOTS features and a bias, by averaged adaptive gradient steps on soft targets.

    Labellers and bias start at the model's log-odds, words at nothing. Small samples are gone over more often, for least_steps steps in all. Weights decay, but for those of labellers and the bias; words of fewer than least_texts texts have none.
    """
    weights, seen = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-3)
    weights[: len(LABELLERS)], weights[SLOTS] = model.weights()
    if not len(texts):
        return weights
    often = np.zeros(SLOTS, np.int64)
    for at in range(0, len(texts), 256):
        often += np.bincount(np.concatenate(texts[at : at + 256]), minlength=SLOTS)
    often = often >= least_texts
    texts = [np.append(t[often[t]], SLOTS) for t in texts]
    batches = max(1, len(texts) // 32)
    epochs = max(epochs, math.ceil(least_steps / batches))
    order, total, steps = np.random.default_rng(7), np.zeros(SLOTS + 1), 0
    for epoch in range(epochs):
        for batch in np.array_split(order.permutation(len(texts)), batches):
            slots = np.concatenate([texts[i] for i in batch])
            sizes = [len(texts[i]) for i in batch]
            row = np.repeat(np.arange(len(batch)), sizes)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[slots], minlength=len(batch)), -30, 30)))
            used, at = np.unique(slots, return_inverse=True)
            slope = np.bincount(at, weights=(p - target[batch])[row]) + decay * len(batch) * np.where((used >= len(LABELLERS)) & (used < SLOTS), weights[used], 0)
            seen[used] += slope**2
            weights[used] -= rate * slope / np.sqrt(seen[used])
        if epoch >= epochs // 2:
            total, steps = total + weights, steps + 1
    return total / max(steps, 1)


def given_labels(labels: DataFrame) -> DataFrame:
    """doc_id and given: 1 where a label says low quality or toxic, else 0."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("given")).filter("doc_id is not null and given is not null").groupBy("doc_id").agg(F.max("given").alias("given"))


def _slim(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    texts = column(batch, "text")
    for at, n in text_slices(texts, 4 << 20):
        yield batch.slice(at, n), split_words(texts.slice(at, n))


def _half() -> Column:
    """Which half of all documents one is in."""
    return F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(2)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """half, word, n and bad: labelled texts with the word, and bad ones of them, a row a word of some texts."""
    for batch in batches:
        for part, w in _parts(batch):
            if not len(w.codes):
                continue
            half, given = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("half", "given"))
            bare = _bare(w).dictionary_encode()
            words, kinds = bare.dictionary, len(bare.dictionary)
            pairs = np.unique(w.parent * kinds + bare.indices.to_numpy(zero_copy_only=False)[w.codes])
            keys, at = np.unique(half[pairs // kinds] * kinds + pairs % kinds, return_inverse=True)
            columns = [pa.array(keys // kinds, pa.int32()), words.take(pa.array(keys % kinds)), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=given[pairs // kinds]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["half", "word", "n", "bad"])


def telling_words(sample: DataFrame) -> tuple[list[str], list[str]]:
    """The words that each half of sample (half, given, text) tells bad texts by; ties go by the word."""
    known = sample.filter("given >= 0")
    shares = {r["half"]: r["share"] for r in known.groupBy("half").agg(F.avg("given").alias("share")).collect()}
    share = F.when(F.col("half") == 0, F.lit(shares.get(0, 1.0))).otherwise(F.lit(shares.get(1, 1.0)))
    words = known.select("half", "given", "text").mapInArrow(_counted, "half int, word string, n bigint, bad bigint")
    words = words.groupBy("half", "word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    words = words.filter((F.col("n") >= TELLING_TEXTS) & (F.length("word") <= TELLING_LENGTH) & (F.col("word") != "") & (share < 1))
    apart = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    mostly = F.col("bad") >= TELLING_SHARE * F.col("n")
    top = words.withColumn("apart", apart).filter((F.col("apart") >= TELLING_DEVIATIONS) & mostly).orderBy(F.desc("apart"), "word", "half").limit(TELLING_WORDS).collect()
    return [r["word"] for r in top if r["half"] == 0], [r["word"] for r in top if r["half"] == 1]


def _voted(telling: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in _parts(batch):
                half = part.column(part.schema.get_field_index("half")).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fired(w, telling.value, half), pa.int64())], names=["doc_id", "votes"])

    return voted


def _featured(telling: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in _parts(batch):
                place, doc_id, half, given = (part.column(part.schema.get_field_index(c)) for c in ("place", "doc_id", "half", "given"))
                votes = fired(w, telling.value, half.to_numpy())
                text, slot = features(w, votes)
                bounds = np.searchsorted(text, np.arange(w.n_texts + 1))
                held = [slot[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([place, doc_id, pa.array(votes, pa.int64()), given, pa.array(held, pa.binary())], names=["place", "doc_id", "votes", "given", "slots"])

    return featured


@dataclass
class Classifier:
    """telling: the words that each half tells bad texts by."""

    labellers: LabelModel
    telling: tuple[list[str], list[str]]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 1 << 25) -> Classifier:
    """Labellers from all documents; telling words and the scorer from at most max_rows labelled ones, or the scorer from
    as many of all if none is labelled.

    The driver gets one row for each joint pattern of votes (at most 2^5 x 3), at most TELLING_WORDS words, and the
    sample's hashed features, of four bytes each: the scorer learns from the first rows, by hash, that have
    at most max_features (128 MB) together. A text has no more than SLOTS of them.
    """
    given = stash(given_labels(labels), "given")
    # the least by hash, so the sample depends on the tables alone; without labels, of all documents
    slim = _slim(docs).withColumn("half", _half())
    ids = given if given.limit(1).count() else slim.select("doc_id").filter("doc_id is not null").distinct().withColumn("given", F.lit(-1))
    chosen = ids.withColumn("place", F.xxhash64(F.lit(11), "doc_id")).orderBy("place", "doc_id").limit(max_rows)
    chosen = F.broadcast(stash(chosen, "chosen"))
    # of rows with one doc_id the least text teaches, so that no id counts twice
    sample = stash(slim.join(chosen, "doc_id").groupBy("place", "doc_id", "half", "given").agg(F.min("text").alias("text")), "sample")
    telling = telling_words(bounded(sample))
    shared = docs.sparkSession.sparkContext.broadcast(telling)

    voted = slim.mapInArrow(_voted(shared), "doc_id bigint, votes bigint")
    # rows of one id and pattern, null ids too, are one row by the time they meet their label
    alike = voted.groupBy("doc_id", "votes").agg(F.count("*").alias("n"))
    patterns = alike.join(given, "doc_id", "left").groupBy("votes", F.coalesce("given", F.lit(-1)).alias("given")).agg(F.sum("n").alias("n")).toArrow()
    columns = [patterns.column(c).to_numpy().astype(np.int64) for c in ("votes", "given", "n")]
    model = fit_labellers(columns[0], columns[1], columns[2].astype(float))

    featured = stash(bounded(sample).mapInArrow(_featured(shared), "place bigint, doc_id bigint, votes bigint, given int, slots binary"), "features")
    sizes = featured.select("place", "doc_id", (F.octet_length("slots") / 4).cast("long").alias("n")).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    fits = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), max_features, side="right"))
    if fits < sizes.num_rows:
        # a place is a hash that few ids share, if any; all of them are left out
        featured = featured.filter(F.col("place") < sizes.column("place")[fits].as_py())
    rows = featured.toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    target = model.posterior(rows.column("votes").to_numpy(), rows.column("given").to_numpy()) if rows.num_rows else np.empty(0)
    texts = [np.frombuffer(s.as_buffer(), "<i4") for s in rows.column("slots")]
    return Classifier(model, telling, train_scorer(texts, target, model))


def score(docs: DataFrame, classifier: Classifier, threshold: float = 0.5) -> DataFrame:
    """doc_id, votes, posterior (of the votes alone), score (P(bad)) and kept of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.labellers, classifier.telling, classifier.weights.astype(np.float32)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, telling, weights = shared.value
        for batch in batches:
            for part, w in _parts(batch):
                votes = fired(w, telling)
                text, slot = features(w, votes)
                total = np.bincount(text, weights=weights[slot], minlength=w.n_texts) + weights[SLOTS]
                p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.int64()), pa.array(model.posterior(votes)), pa.array(p), pa.array(p < threshold)], names=["doc_id", "votes", "posterior", "score", "kept"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("votes", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return _slim(docs).mapInArrow(scored, schema)
