"""Spelling variants by permuterm rotations.

Words are counted over all documents. Each word is marked with a terminator and rotated in every way. Where a
word reads x c y, the rotation that ends in the edited character is y $ x c: so words that differ in that
character alone have rotations with the same prefix y $ x, which skips it, and the word x y, from which
the character is missing, has this prefix as a rotation of its own. Spark deals the rotations by prefix and
sorts them; one scan of a prefix tells how many words it brings together and the most frequent of them, so
neighbours are counted and the best one found without a row for each pair. A prefix has at most one
word of its own and one for each letter, so no group grows with the data. Words are numbered in the order of their code
points, and rotations carry numbers. A prefix of over `SPELLED` characters is told by a hash of 120 bits that is
rolled on from rotation to rotation, so a word of a million letters makes rows in proportion to its length.

A pair that differs in one character has one prefix. A word that misses a letter of a double one would meet at two
prefixes; only the last letter of a run of equal ones counts as the missing one, so each pair is met once.

Cases: null and empty texts have no runs; a null doc_id reads as an empty string in the dealt hash; rows of one doc_id
are counted one by one, as repeated rows are; of words with equal counts the smaller by code points is the form; a word of any length is compared
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, column, keyed_join, stash

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Of the runs, those whose hash this divides lose a character.
DROPPED = 31
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: Sorts before all letters and is in no word.
END = "$"
#: Prefixes of so many characters are spelled out in rotations.
SPELLED = 48
#: Prime moduli under 2^30 and a base for each.
_MODULI = [(1073741789, 777767777), (1073741783, 345678923), (1073741741, 912673459), (1073741723, 160481183)]


def read_as(doc_id: object, run: str, dropped: int = DROPPED) -> str:
    """The word that a lower-cased run of a document counts as."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % dropped == 0 else run


def _counted(min_length: int, dropped: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), column(batch, "text"), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall(text.as_py().translate(_LOWER))).items():
                    if len(run) >= min_length:  # a shorter run makes no word that is long enough
                        h = zlib.crc32(run.encode(), start)
                        if h % dropped == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_length:
                                continue
                        held[run] += n
            if len(held) > 200_000:
                yield rows()
        yield rows()

    return counted


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dropped: int = DROPPED) -> DataFrame:
    """word, n of the words of all documents that are long and frequent enough."""
    slim = bounded(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = slim.mapInArrow(_counted(min_length, dropped), "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def numbered(words: DataFrame) -> DataFrame:
    """Written: id, word, n; ids rise with the words' code points."""
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stash(words.repartitionByRange(parts, "word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def _rolled(word: str) -> tuple[list[str], list[str]]:
    """Hashes of the rotations that skip character i, and of the whole ones that end in it, for all i."""
    codes = np.frombuffer((word + END).encode("utf-32-le"), "<u4").astype(np.uint64)
    n, parts = len(codes), ([], [])
    for m, base in _MODULI:
        up = np.ones(n + 1, np.uint64)
        down = np.ones(n + 1, np.uint64)
        for powers, b in ((up, base), (down, pow(base, -1, m))):  # powers of b, twice as many each round
            have = 1
            while have <= n:
                more = min(have, n + 1 - have)
                powers[have : have + more] = powers[:more] * np.uint64(pow(b, have, m)) % np.uint64(m)
                have += more
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:n] % np.uint64(m))]) % np.uint64(m)
        after = (sums[n] + np.uint64(m) - sums[1:]) % np.uint64(m) * down[1 : n + 1] % np.uint64(m)
        skipped = (after + sums[:n] * up[n - 1 :: -1][:n]) % np.uint64(m)
        parts[0].append(skipped)
        parts[1].append((skipped + codes * up[n - 1]) % np.uint64(m))
    text = lambda columns, size: ["%d:%08x%08x%08x%08x" % (size, *x) for x in zip(*(c.tolist() for c in columns), strict=True)]
    return text(parts[0], n - 1), text(parts[1], n)


def _long_rotations(spelled: int):
    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of rotations() for words of `spelled` characters and more."""
        for batch in batches:
            for number, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                marked, size = word + END, len(word)
                skipped, whole = _rolled(word)
                if size <= spelled:
                    skipped = [marked[i + 1 :] + marked[:i] for i in range(size + 1)]
                kinds = [int(marked[i] == marked[i + 1]) for i in range(size)]
                rows = [*zip(skipped, kinds, strict=False), *((w, 2) for w in whole)]
                for at in range(0, len(rows), 20_000):
                    prefix, kind = zip(*rows[at : at + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(kind, pa.int32()), pa.array([number] * len(kind), pa.int64()), pa.array([n] * len(kind), pa.int64())], names=["prefix", "kind", "id", "n"])

    return rolled


def rotations(words: DataFrame) -> DataFrame:
    """prefix, kind, id, n: of each rotation but that ending in the terminator its prefix without the last character (kind
    0, or 1 if the next character is the same one, so that it isn't the last of its run), and each whole rotation (kind 2).
    """
    marked, n = F.concat("word", F.lit(END)), F.length("word")
    at = words.filter(n < SPELLED).select("id", "n", marked.alias("marked"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    turned = at.select("id", "n", F.concat(F.expr("substring(marked, i + 2)"), F.expr("substring(marked, 1, i)")).alias("rest"), F.expr("substring(marked, i + 1, 1)").alias("c"))
    # i is the character that the rotation ends in: rest is the prefix that skips it, rest + c the whole rotation
    kind = F.when(F.substring("rest", 1, 1) == F.col("c"), 1).otherwise(0)
    entries = F.array(F.struct(F.concat("rest", "c").alias("prefix"), F.lit(2).alias("kind")), F.struct(F.col("rest").alias("prefix"), F.when(F.col("c") != END, kind).alias("kind")))
    short = turned.select("id", "n", F.inline(entries)).filter("kind is not null").select("prefix", "kind", "id", "n")
    long = bounded(words).filter(n >= SPELLED).select("id", "word", "n").mapInArrow(_long_rotations(SPELLED), "prefix string, kind int, id bigint, n bigint")
    return short.union(long)


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best (minus its count, id) of all numbered words that have a neighbour."""
    # less is better: the larger count, then the smaller word
    rows = rotations(words).select("prefix", "kind", "id", (-F.col("n")).alias("minus"))
    rank = F.struct("minus", "id")
    by_rank = Window.partitionBy("prefix").orderBy("minus", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.when(F.col("kind") < 2, rank)
    scanned = rows.select(
        "kind", "id",
        F.sum((F.col("kind") < 2).cast("int")).over(by_rank).alias("members"),
        F.sum((F.col("kind") == 0).cast("int")).over(by_rank).alias("longer"),
        F.min(F.when(F.col("kind") == 2, rank)).over(by_rank).alias("whole"),
        F.min(F.when(F.col("kind") == 0, rank)).over(by_rank).alias("best_longer"),
        F.nth_value(held, 1, True).over(by_rank).alias("first"),
        F.nth_value(held, 2, True).over(by_rank).alias("second"),
    )
    other = F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    short = F.when(F.col("kind") == 0, F.col("whole"))
    near = F.when(F.col("kind") == 2, F.col("longer")).otherwise(F.col("members") - 1 + short.isNotNull().cast("int"))
    best = F.when(F.col("kind") == 2, F.col("best_longer")).otherwise(F.least(other, short))
    found = scanned.filter("members + if(whole is null, 0, 1) > 1").select("id", near.cast("long").alias("near"), best.alias("best"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).filter("n_near > 0")


def roots(forms: DataFrame, rows: int) -> DataFrame:
    """id, form, root of the rows (id, form): forms are followed to the last, each round twice as far.

    A form has ten times the count of its word, so the rounds are few.
    """
    ahead = stash(forms.select("id", "form", F.col("form").alias("root")), "forms")
    while True:
        step = ahead.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = stash(keyed_join(ahead, step, "root", rows, "left").select("id", "form", F.coalesce("next", "root").alias("root"), "next"), "roots")
        ahead = joined.select("id", "form", "root")
        if not joined.filter("next is not null").limit(1).count():
            return ahead


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, dropped: int = DROPPED) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words."""
    words = numbered(word_counts(docs, min_length, min_count, dropped))
    near = stash(neighbours(words), "neighbours")
    total = near.count()
    told = keyed_join(words, near, "id", total, "left")
    told = stash(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best.id")).alias("form")), "variants")
    forms = told.filter("form is not null").select("id", "form")
    named, all_words = roots(forms, total), words.count()
    for key in ("form", "root"):
        named = keyed_join(named, words.select(F.col("id").alias(key), F.struct("word", "n").alias(f"{key}_word")), key, all_words)
    named = named.select("id", F.col("form_word.word").alias("form"), F.col("form_word.n").alias("form_n"), F.col("root_word.word").alias("root"))
    return keyed_join(told.drop("form"), named, "id", total, "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
