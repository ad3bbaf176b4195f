"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior.

Every document is held against plain rules: the base rules, which reject it by itself, and rules on
symbols, repeated lines and the length of words. The documents that fail any rule are counted for
each host, the host's failure rate is shrunk towards the rate of all hosts by a beta prior that is
fitted to the hosts by the method of moments, and a host is rejected with all its documents if its
shrunk rate reaches `max_rate`, or stands out: by `OUTLYING` standard deviations of the prior and at
least twice the prior's mean. Documents that fail a base rule are rejected anyway.

Cases: a null text has no words and fails; a null host counts as the empty host; repeated
rows are judged one by one; equal rates get equal verdicts; very long texts are counted whole, one
such text at a time; an empty table gives an empty result; other columns, whatever their names, are
ignored by judge() and handed on by keep_good().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, column, keyed_join, stash, text_slices
from .words import mixed, split_words, windows

WINDOW = 5
#: Standard deviations of the prior by which a host stands out.
OUTLYING = 4
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of some texts without nulls."""
    w = split_words(texts)
    n = len(texts)
    chars = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False)
    symbols = pc.count_substring_regex(w.vocab, SYMBOLS).to_numpy(zero_copy_only=False)
    per_text = lambda values: np.bincount(w.parent, weights=values[w.codes], minlength=n).astype(np.int64)
    hashes, begin = windows(mixed(w.codes.astype(np.uint64) + np.uint64(1)), w.parent, WINDOW)
    keys = hashes ^ mixed(w.parent[begin].astype(np.uint64) + np.uint64(1 << 40))
    _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(len(w.codes) + 1, np.int64)
    again = begin[times[where] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    lists = pc.split_pattern(texts, "\n")
    line_parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lists.flatten().dictionary_encode()
    codes, kinds = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(lines.dictionary)
    worded = pc.match_substring_regex(lines.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False).astype(bool)
    held = worded[codes] if kinds else np.zeros(0, bool)
    line_parent, codes = line_parent[held], codes[held]
    distinct = np.unique(line_parent * max(kinds, 1) + codes) // max(kinds, 1)
    return {
        "n_words": w.counts,
        "word_chars": per_text(chars) if len(w.vocab) else np.zeros(n, np.int64),
        "n_symbols": per_text(symbols) if len(w.vocab) else np.zeros(n, np.int64),
        "n_dup_lines": np.bincount(line_parent, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": np.bincount(w.parent[covered], minlength=n),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rest = column(batch, "text"), batch.drop_columns(["text"])
        for at, n in text_slices(texts):
            part = rest.slice(at, n)
            counts = rule_counts(texts.slice(at, n))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=[*part.schema.names, *COUNTS])


def rule_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of every document."""
    slim = bounded(docs).select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([f for f in slim.schema.fields if f.name != "text"] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return slim.mapInArrow(_counted, schema)


def failed_rules(n_words: Column, n_repeat_words: Column) -> Column:
    """The base rules: fewer than ten words, or over a fifth of the words in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def failed_any(count: Callable[[str], Column]) -> Column:
    """The base rules, symbols for over a tenth of the words, repeated lines for over a twentieth, or words of under 3 or over 12 characters on average."""
    n = count("n_words")
    base = failed_rules(n, count("n_repeat_words"))
    return base | (10 * count("n_symbols") > n) | (20 * count("n_dup_lines") > n) | (count("word_chars") < 3 * n) | (count("word_chars") > 12 * n)


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, documents, failures, rate, host_rejected from rows with host and failed.

    Prior: with m the failure rate of all documents, s2 the variance of the hosts' rates about
    m (each host weighs its documents) and e the part of it that chance explains, the between-
    host variance v = max(s2 - e, 1e-6) gives a + b = m (1 - m) / v - 1, held within 1 and 1e6.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("documents"), F.sum(F.col("failed").cast("long")).alias("failures"))
    hosts = stash(hosts, "hosts")
    n, f = F.col("documents"), F.col("failures")
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q")).first()
    if not sums["n"]:
        return hosts.select("host", "documents", "failures", F.lit(0.0).alias("rate"), F.lit(False).alias("host_rejected"))
    m = sums["f"] / sums["n"]
    between = max(sums["q"] / sums["n"] - m * m - m * (1 - m) * (sums["h"] - 1) / sums["n"], 1e-6)
    weight = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    rate = (F.lit(weight * m) + f) / (F.lit(weight) + n)
    outlying = max(m + OUTLYING * math.sqrt(m * (1 - m) / (weight + 1)), 2 * m)
    return hosts.select("host", "documents", "failures", rate.alias("rate"), (rate >= min(max_rate, outlying) if m else F.lit(False)).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Every document's counts, base_failed, host verdict and kept; one row for each row of docs.

    The counts are made in one pass over the texts and written as a slim table, so hosts and
    documents meet without their texts. Hosts are counted with partial sums, and joined by
    broadcast if they are few, else salted.
    """
    counted = rule_table(docs, host).withColumn("base_failed", failed_rules(F.col("n_words"), F.col("n_repeat_words")))
    judged = stash(counted.withColumn("failed", failed_any(F.col)), "rules")
    verdicts = host_verdicts(judged, max_rate).select("host", "rate", "host_rejected")
    joined = keyed_join(judged, verdicts, "host", verdicts.count())
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected"))).drop("failed")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _all_counts(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    parts = [rule_counts(texts.slice(at, n)) for at, n in text_slices(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS], names=COUNTS)


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs that pass, with docs' columns: the filter form of judge().

    The rules are counted once: each row is written with its two verdicts, inside a struct, so that
    no name clashes; the hosts are counted from those columns alone.
    """
    counted = bounded(docs).select(F.struct("*").alias("doc"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), _all_counts(F.col("text").cast("string")).alias("counts"))
    count = lambda c: F.col(f"counts.{c}")
    judged = stash(counted.select("doc", "host", failed_rules(count("n_words"), count("n_repeat_words")).alias("base_failed"), failed_any(count).alias("failed")), "judged")
    verdicts = host_verdicts(judged.select("host", "failed"), max_rate)
    bad = verdicts.filter("host_rejected").select("host")
    return keyed_join(judged.filter("not base_failed"), bad, "host", bad.count(), "left_anti").select("doc.*")
