"""A language model by online logistic context mixing, trained on a corpus and scoring all of it.

A text is its words (lower-cased A-Z) and one end. Each token is coded in binary decisions, and
each decision is predicted by several hashed contexts whose log-odds are mixed with weights that
a gate (how sure the contexts are) chooses; the mixed prediction is then refined by an adaptive
table. The decisions are

* whether the corpus has the next passage. A passage ends with a word whose hash says so, one word
  in `PASSAGE` on average, and at a text's end. A passage of `LEAST` tokens or more that training
  documents, or the text's own beginning, have is predicted by its count. The counts are a table
  that grows with the input and is joined.
* else, for each token, the bits of a symbol: a frequent word, the end, or an escape. Contexts: the
  state (the language that the last telling word before speaks for), the word before, the two
  words before, and the last bytes before with the state; see `symbols`.
* after an escape, the bytes of the word and a closing space, eight bits each. Contexts: hashes
  of the last one to four bytes, of the whole beginning of the word, and of the last two bytes with
  the state. Words that training has
  are predicted by their own counts as well, which are joined and grow with the input.

Counts are taken from training documents whose crc32(doc_id as text) mod 7 is not 2 or 6, the
weights and the refinement are learned online on those of remainder 6, whose counts are then added, and all
documents are scored. Learning is dealt into lessons of about `LESSON_DOCS` documents (`LESSON_WORDS` words for spelling), by a
hash of what is learned and in its order; lessons learn side by side, and their weights are averaged. How many
there are follows from the corpus, so no lesson grows with it, and neither files nor cores change a score. A training document's own passages are taken off their counts when it is
scored, so that it is predicted by the other documents, as held-out ones are. Every decision has a
probability within 0 and 1, so the probabilities of all token sequences sum to at most 1. The
state is read off the words before, so a score depends on the text and the model alone.

Bounds of the model, whatever the input: 2^17 symbols, 15 states besides none (rarer languages
share the state none), 3 x 2^21 and 6 x 2^19 slots of hashed contexts, which are broadcast. The
tables of words and passages have no bound and are joined. A word or passage that very many
documents have is one row a document on the documents' side of a join; Spark's adaptive skew join
splits its partition.

Cases: a null or empty text is the end alone; a null doc_id counts as remainder 0 and a null
language as one of its own; repeated rows are trained on and scored one by one; words over
`LONGEST` bytes, and words that counted documents have once or never, are never frequent, but scored
whole; an empty table gives an empty result; without training documents all predictions are even
and the base counts are 0; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, column, stash, stash_at, text_slices
from .symbols import CONTEXTS, END, ESCAPE, FIRST_WORD, Coder, PrefixCode, Seen, Tokens, histories, slot_bits, tokens_of
from .words import Words, mixed, split_words

SYMBOL_BITS = 17
#: A passage ends with one word in PASSAGE, and counts as one from LEAST tokens on.
PASSAGE, LEAST = 16, 5
#: The class that marks counts of passages.
PASSAGES = -1
LONGEST = 64
STATES = 15
#: About how much one task learns from.
LESSON_DOCS, LESSON_WORDS = 2048, 1 << 17
ORDERS = (1, 2, 3, 4, 0)  # 0: the whole beginning
#: Contexts of a byte: those, and the last two bytes with the state.
SPELLED = len(ORDERS) + 1
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
#: Bytes of texts that are counted or scored at once.
SLICE = 2 << 20
BLOCK = 4096
LEVELS = 8
BINS = 24
_EDGE = 1e-4
_LN10 = math.log(10)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def levels(n: np.ndarray) -> np.ndarray:
    """How sure counts are, in LEVELS steps."""
    return np.minimum(np.log2(n + 1), LEVELS - 1).astype(np.uint8)


def _mixture(weights: np.ndarray, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The log-odds that each decision's gate mixes; weights: a row for each input, and one for the bias."""
    x = weights[-1].take(gate, mode="clip")
    for k in range(len(weights) - 1):
        term = weights[k].take(gate, mode="clip")
        term *= odds[:, k]
        x += term
    return np.clip(x, -12, 12, out=x)


@dataclass
class Mixer:
    """Gated weights over the log-odds of `inputs` contexts and a bias, with a refining table."""

    inputs: int
    gates: int
    cells: int
    #: The first weights of the inputs, all alike if not given.
    begin: tuple[float, ...] | None = None
    weights: np.ndarray = field(init=False)
    slope2: np.ndarray = field(init=False)
    hits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = np.full((self.gates, self.inputs + 1), 1.0 / self.inputs)
        self.weights[:, -1] = 0
        if self.begin:
            self.weights[:, :-1] = self.begin
        self.slope2 = np.full_like(self.weights, 1e-2)
        self.hits = np.zeros((self.cells * BINS, 2))

    def mix(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return _mixture(np.ascontiguousarray(self.weights.T, odds.dtype), odds, gate)

    def learn(self, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float = 0.05) -> None:
        """One online step on some decisions, each counting `weight` times."""
        error = (squash(self.mix(odds, gate)) - bit) * weight
        total = np.maximum(np.bincount(gate, weights=weight, minlength=self.gates), 1e-9)
        for k in range(self.inputs + 1):
            g = np.bincount(gate, weights=error * odds[:, k] if k < self.inputs else error, minlength=self.gates) / total
            self.slope2[:, k] += g * g
            self.weights[:, k] -= rate * g / np.sqrt(self.slope2[:, k])

    def _cell(self, mixed_odds: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return cell * BINS + np.minimum(((mixed_odds + 12) * (BINS / 24)).astype(np.int64), BINS - 1)

    def adapt(self, odds: np.ndarray, gate: np.ndarray, cell: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Count what the decisions of each cell of the refining table turned out to be."""
        at = self._cell(self.mix(odds, gate), cell)
        self.hits[:, 0] += np.bincount(at, weights=weight * (1 - bit), minlength=len(self.hits))
        self.hits[:, 1] += np.bincount(at, weights=weight * bit, minlength=len(self.hits))

    def predict(self, odds: np.ndarray, gate: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """P(bit is 1): the mixture, averaged with what its cell has seen as far as that is sure."""
        return self.predictor(odds.dtype)(odds, gate, cell)

    def predictor(self, dtype: np.dtype) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """predict() for many calls, with what the mixer has learned by now."""
        weights = np.ascontiguousarray(self.weights.T, dtype)
        n, ones = self.hits.sum(1).astype(dtype) + 8, np.ascontiguousarray(self.hits[:, 1], dtype)

        def predict(odds: np.ndarray, gate: np.ndarray, cell: np.ndarray) -> np.ndarray:
            x = _mixture(weights, odds, gate)
            at = self._cell(x, cell)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            p = np.divide(1, x, out=x)
            seen = 8 * p
            seen += ones.take(at, mode="clip")
            seen /= n.take(at, mode="clip")
            p += seen
            p /= 2
            return np.clip(p, _EDGE, 1 - _EDGE, out=p)

        return predict

    def numbers(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.hits.ravel()])

    def load(self, weights: np.ndarray, hits: np.ndarray) -> Mixer:
        self.weights, self.hits = weights.reshape(self.weights.shape), hits.reshape(self.hits.shape)
        return self


# ---- symbols


@dataclass
class SymbolModel:
    """log10 P(symbol) for each state, 0 being none, over 2^SYMBOL_BITS symbols."""

    table: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, checks: np.ndarray) -> SymbolModel:
        """counts, checks: how often each state (first: all together) has each symbol in the two folds."""
        states, size = counts.shape
        trees, tests = [counts], [checks]
        while trees[0].shape[1] > 1:
            trees.insert(0, trees[0][:, 0::2] + trees[0][:, 1::2])
            tests.insert(0, tests[0][:, 0::2] + tests[0][:, 1::2])
        bits = len(trees) - 1
        mixer = Mixer(2, LEVELS * LEVELS, bits)

        def decisions(depth: int, state: int) -> tuple[np.ndarray, ...]:
            out = []
            for s in (state, 0):
                n0, n1 = trees[depth + 1][s, 0::2], trees[depth + 1][s, 1::2]
                out += [np.clip(np.log((n1 + 0.03) / (n0 + 0.03)), -9, 9), levels(n0 + n1)]
            return np.stack([out[0], out[2]], axis=1), out[1].astype(np.int64) * LEVELS + out[3]

        total = checks.sum() or 1
        for stage in ("learn", "learn", "adapt"):
            for _ in range(8 if stage == "learn" else 1):
                for state in range(states):
                    for depth in range(bits):
                        test = tests[depth + 1][state]
                        weight = np.concatenate([test[0::2], test[1::2]]) * (1e4 / total if stage == "learn" else 1)
                        on = np.flatnonzero(weight)
                        if not len(on):
                            continue
                        odds, gate = decisions(depth, state)
                        half = len(gate)
                        bit, at = (on >= half).astype(float), on % half
                        if stage == "learn":
                            mixer.learn(odds[at], gate[at], bit, weight[on])
                        else:
                            mixer.adapt(odds[at], gate[at], np.full(len(on), depth), bit, weight[on])
        # what the weights were taught on is counted as well from here on
        trees = [n + t for n, t in zip(trees, tests, strict=True)]
        table = np.zeros((states, 1))
        for depth in range(bits):
            deeper = np.empty((states, table.shape[1] * 2))
            for state in range(states):
                p = mixer.predict(*decisions(depth, state), np.full(table.shape[1], depth))
                deeper[state, 0::2], deeper[state, 1::2] = table[state] + np.log10(1 - p), table[state] + np.log10(p)
            table = deeper
        return SymbolModel(table.astype(np.float32))


def symbol_mixer() -> Mixer:
    return Mixer(1 + CONTEXTS, 512, 64, (1.0, *[0.3] * CONTEXTS))


def log10_symbols(coder: Coder, table: np.ndarray, mixer: Mixer, t: Tokens) -> np.ndarray:
    """log10 P(symbol) of each token, given the tokens before it; table: histories of CONTEXTS x slots."""
    out, predict = np.empty(len(t.symbol)), mixer.predictor(np.dtype(np.float32))
    for some, begin, decisions in coder.runs(t):
        p = predict(*decisions.inputs(table)).astype(float)
        p -= 1 - decisions.bit  # of the bit: p or 1 - p
        # at least _EDGE ** 60, as no code is that long
        out[some] = np.multiply.reduceat(np.abs(p, out=p), begin)
    return np.log10(out, out=out)


# ---- passages


@dataclass
class Passages:
    """The passages of some texts: where each begins among the tokens, its size, text and key."""

    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    key: np.ndarray


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word: the scrambled sum of its bytes, each scrambled with its place."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(data + (place << 8).astype(np.uint64)), dtype=np.uint64)])
    return mixed(running[ends[1:]] - running[ends[:-1]])


def passages_of(w: Words, place: np.ndarray, first: np.ndarray) -> Passages:
    """place, first: where words and texts lie among the tokens, as in Tokens."""
    n = int(first[-1])
    token = np.full(n, 0x5851F42D4C957F2D, np.uint64)
    if len(w.codes):
        token[place] = word_hashes(w.vocab)[w.codes]
    last = (mixed(token) % np.uint64(PASSAGE)) == 0
    last[first[1:] - 1] = True
    stop = np.flatnonzero(last) + 1
    begin = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(stop) else np.empty(0, np.int64)
    size = stop - begin
    inside = np.arange(n) - np.repeat(begin, size)
    terms = mixed(token + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = mixed(np.add.reduceat(terms, begin) + size.astype(np.uint64)) if n else np.empty(0, np.uint64)
    return Passages(begin, size, np.searchsorted(first, begin, side="right") - 1, key.view(np.int64))


# ---- bytes of words after an escape


@dataclass
class Spelled:
    """The bytes of some words, each closed with a space, and their context hashes."""

    data: np.ndarray
    owner: np.ndarray
    contexts: np.ndarray

    def slots(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots by order, the bit) of every byte's bit, the highest being 0."""
        node = _BYTE_NODES[bit].take(self.data)
        at = self.contexts ^ node
        at *= np.uint64(0xD6E8FEB86659FD93)
        at >>= np.uint64(64 - SLOT_BITS)
        return at.view(np.int64), (self.data >> (7 - bit)) & 1


#: The scrambled node of each byte's tree before each of its bits.
_BYTE_NODES = (np.uint64(1) << np.arange(8, dtype=np.uint64)[:, None] | np.arange(256, dtype=np.uint64) >> np.arange(8, 0, -1, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)


def spell(words: pa.Array, states: np.ndarray | None = None) -> Spelled:
    """words: binary; states: the state before each of them, none if not given."""
    closed = pc.binary_join_element_wise(words, pa.scalar(b"", pa.binary()), b" ")
    sizes = pc.binary_length(closed).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(closed.to_pylist()), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - first[owner]
    before = np.zeros(len(data), np.uint64)
    contexts = []
    for back in range(1, max(ORDERS) + 1):
        last = np.where(place >= back, np.roll(data, back), 32).astype(np.uint64)
        before = before | last << np.uint64(8 * (back - 1))
        contexts.append(mixed(before + np.uint64(back << 48)))
    # the beginning: an incremental hash, as a running sum of terms that the place scatters
    terms = mixed(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    running = np.cumsum(terms, dtype=np.uint64)
    base = running[first] - terms[first] if len(data) else running
    contexts.append(mixed(running - terms - base[owner] + place.astype(np.uint64)))
    told = np.zeros(len(sizes), np.int64) if states is None else states
    two = np.where(place >= 2, np.roll(data, 2), 32).astype(np.int64) << 8 | np.where(place >= 1, np.roll(data, 1), 32)
    contexts.append(mixed((two << 5 | told[owner]).astype(np.uint64) + np.uint64(9 << 48)))
    return Spelled(data, owner, np.stack(contexts))


@dataclass
class ByteModel:
    """Log-odds and sureness of every slot by order, and the mixer over them."""

    odds: np.ndarray
    sure: np.ndarray
    mixer: Mixer

    @staticmethod
    def new_mixer() -> Mixer:
        return Mixer(SPELLED, LEVELS * LEVELS, 8 * LEVELS)

    @staticmethod
    def of(zeros: np.ndarray, ones: np.ndarray) -> ByteModel:
        return ByteModel(np.clip(np.log((ones + 0.05) / (zeros + 0.05)), -9, 9).astype(np.float16), levels(zeros + ones), ByteModel.new_mixer())

    def decisions(self, s: Spelled, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """odds, gate, cell and bit of every byte's bit."""
        at, value = s.slots(bit)
        odds = np.empty(at.shape, np.float32)
        for k in range(SPELLED):
            odds[k] = self.odds[k].take(at[k], mode="clip")
        sure = {k: self.sure[k].take(at[k], mode="clip").astype(np.int64) for k in (1, 2, 4)}
        return odds.T, sure[4] * LEVELS + sure[2], bit * LEVELS + sure[1], value

    def log10_probability(self, words: pa.Array, states: np.ndarray | None = None) -> np.ndarray:
        s = spell(words, states)
        total, predict = np.zeros(len(s.data)), self.mixer.predictor(np.dtype(np.float32))
        for bit in range(8):
            odds, gate, cell, value = self.decisions(s, bit)
            p = predict(odds, gate, cell)
            total += np.log(np.where(value, p, 1 - p))
        return np.bincount(s.owner, weights=total, minlength=len(words)) / _LN10


def _runs(words: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    yield from text_slices(words, limit)


SHARES = np.concatenate([[0.0], 1 / (1 + np.exp(-np.arange(-6, 4.25, 0.25)))])


def mixed_with_counts(share: float, counted: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 of share * counted + (1 - share) * 10 ** spelled: a distribution over words, as both are."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(share * counted), np.log1p(-share) + spelled * _LN10) / _LN10


# ---- Spark: counts


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7: 2 is held out, 6 teaches the weights, all others are counted."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(0)).cast("int")


@dataclass
class LanguageModel:
    """What scoring broadcasts; each array has a fixed bound."""

    counts: np.ndarray
    symbols: SymbolModel
    coder: Coder
    table: np.ndarray
    mixer: Mixer
    spelling: ByteModel
    end_count: int
    tokens: int
    kinds: int
    #: Where the written table of words and passages lies.
    passages: str
    #: How many passages training has, and how likely the next one is among those counted.
    n_passages: int
    known_share: float
    #: Of escaped words: how much the words' own training counts weigh, and their sum.
    share: float = 0.0
    rare_tokens: int = 0

    @property
    def words(self) -> list[bytes]:
        """The frequent words, in the order of their symbols."""
        return self.coder.words.to_pylist()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.kinds + 1))

    def escaped(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 P(word | escape) from training counts and the log10 probabilities of spelling."""
        return mixed_with_counts(self.share, c / max(self.rare_tokens, 1), spelled)

    def passage(self, count: np.ndarray, times: np.ndarray, others: np.ndarray) -> np.ndarray:
        """log10 P of taking a passage `times` times from those counted, the first time with this count; others: passages of the text."""
        rising = np.array([math.lgamma(c + n) - math.lgamma(c) if n > 1 else math.log(c) for c, n in zip(count.tolist(), times.tolist(), strict=True)]) / _LN10
        return rising + times * (math.log10(self.known_share) - np.log10(self.n_passages + others))


def _counted(languages: list[str]):
    place = {x: i + 1 for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, cls and its counts in the three folds, for some MB of texts at a time; keys of passages likewise."""
        for batch in batches:
            texts = column(batch, "text")
            folds = _fold_places(batch)
            cls = np.array([place.get(x, 0) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
            for at, n in text_slices(texts, 4 << 20):
                w = split_words(texts.slice(at, n), lower=True)
                yield from _passage_counts(w, folds[at : at + n])
                if not len(w.codes):
                    continue
                kinds = len(w.vocab)
                key = (cls[at : at + n][w.parent] * kinds + w.codes) * 3 + folds[at : at + n][w.parent]
                counts = np.bincount(key, minlength=(len(languages) + 1) * kinds * 3).reshape(-1, 3)
                held = np.flatnonzero(counts.any(1))
                for begin in range(0, len(held), 100_000):
                    part = held[begin : begin + 100_000]
                    yield pa.RecordBatch.from_arrays([w.vocab.take(pa.array(part % kinds)).cast(pa.binary()), pa.array(part // kinds, pa.int32()), *(pa.array(counts[part, k], pa.int64()) for k in range(3))], names=["word", "cls", "a", "b", "h"])

    return counted


def _as_bytes(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys.astype(">i8").tobytes())]).cast(pa.binary())


def _passage_counts(w: Words, folds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys of passages, marked by the class PASSAGES, and their counts in the three folds."""
    p = passages_of(w, np.arange(len(w.codes)) + w.parent, np.concatenate([[0], np.cumsum(w.counts + 1)]))
    held = p.size >= LEAST
    keys, where = np.unique(p.key[held], return_inverse=True)
    counts = np.bincount(where * 3 + folds[p.text[held]], minlength=3 * len(keys)).reshape(-1, 3)
    data = _as_bytes(keys)
    for begin in range(0, len(keys), 100_000):
        part = slice(begin, begin + 100_000)
        n = len(keys[part])
        yield pa.RecordBatch.from_arrays([data[part], pa.array(np.full(n, PASSAGES), pa.int32()), *(pa.array(counts[part, k], pa.int64()) for k in range(3))], names=["word", "cls", "a", "b", "h"])


def _blocks(tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbered blocks of BLOCK counts, but for empty ones."""
    blocks = np.asarray(tables, "<f4").reshape(-1, BLOCK)
    held = np.flatnonzero(blocks.any(1))
    for begin in range(0, len(held), 64):
        part = held[begin : begin + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blocks[i].tobytes() for i in part], pa.binary())], names=["block", "counts"])


def _context_counts(shared):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of how often each slot of the symbols' contexts has seen a zero and a one in a task's texts."""
        seen = Seen(shared.value)
        for batch in batches:
            texts = column(batch, "text")
            for at, n in text_slices(texts, SLICE):
                seen.add(tokens_of(seen.coder, texts.slice(at, n))[2])
        seen.count()
        yield from _blocks(seen.tables)

    return counted


def _symbol_trainer(shared):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights that a task's texts teach one after another, and what they refine."""
        coder, table = shared.value
        mixer, seen, step = symbol_mixer(), 0.0, 0
        for batch in batches:
            texts = column(batch, "text")
            for at, n in text_slices(texts, 1 << 20):
                _, _, t = tokens_of(coder, texts.slice(at, n))
                for _, _, decisions in coder.runs(t):
                    odds, gate, cell = decisions.inputs(table)
                    bit = decisions.bit.astype(float)
                    for begin in range(0, len(bit), 1 << 14):
                        some = slice(begin, begin + (1 << 14))
                        weight = np.ones(len(bit[some]))
                        if step >= 8:
                            mixer.adapt(odds[some], gate[some], cell[some], bit[some], weight)
                        mixer.learn(odds[some], gate[some], bit[some], weight, 0.02)
                        seen, step = seen + len(weight), step + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([mixer.weights.tobytes()], pa.binary()), pa.array([mixer.hits.tobytes()], pa.binary())], names=["seen", "weights", "hits"])

    return trained


def _fold_places(batch: pa.RecordBatch) -> np.ndarray:
    """0: counted, 1: teaches, 2: held out."""
    fold_ = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
    return np.where(fold_ == 2, 2, np.where(fold_ == 6, 1, 0)).astype(np.int64)


def _spelling_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the slot counts of all words of a task."""
    tables = np.zeros((2, SPELLED, SLOTS), np.float32)
    flat = tables.reshape(-1)
    for batch in batches:
        words, states = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        for at, n in _runs(words):
            s = spell(words.slice(at, n), states[at : at + n])
            for bit in range(8):
                slots, value = s.slots(bit)
                side = value.astype(np.int64) * (SPELLED * SLOTS)
                for k in range(SPELLED):
                    slots[k] += side
                    np.add.at(flat, slots[k] + k * SLOTS, np.float32(1))
    yield from _blocks(tables)


def _summer(to_histories: bool):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block, from rows that are sorted by block: the sums of its counts, or the histories of its slots."""
        held, total = None, None

        def row() -> pa.RecordBatch:
            data = histories(total[0::2], total[1::2]) if to_histories else total
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != held:
                    if held is not None:
                        yield row()
                    held, total = block, np.zeros(BLOCK, "<f4")
                total = total + np.frombuffer(counts.as_buffer(), "<f4")
        if held is not None:
            yield row()

    return summed


def _mixer_trainer(shared):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights that a task's words teach one after another, and what they refine."""
        model: ByteModel = shared.value
        mixer, seen, step = ByteModel.new_mixer(), 0.0, 0
        model = ByteModel(model.odds, model.sure, mixer)
        for batch in batches:
            words, states = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for at, n in _runs(words, 1 << 16):
                s = spell(words.slice(at, n), states[at : at + n])
                weight = np.ones(len(s.owner))
                for bit in range(8):
                    odds, gate, cell, value = model.decisions(s, bit)
                    mixer.learn(odds, gate, value.astype(float), weight)
                    if step >= 8:
                        mixer.adapt(odds, gate, cell, value.astype(float), weight)
                seen, step = seen + weight.sum(), step + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([mixer.weights.tobytes()], pa.binary()), pa.array([mixer.hits.tobytes()], pa.binary())], names=["seen", "weights", "hits"])

    return trained


def _share_judge(shared, rare_tokens: int):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each of SHARES would give a task's escaped words of remainder 6."""
        model: ByteModel = shared.value
        gain = np.zeros(len(SHARES))
        for batch in batches:
            words, states = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            for at, n in _runs(words):
                spelled = model.log10_probability(words.slice(at, n), states[at : at + n])
                gain += [(b[at : at + n] * mixed_with_counts(x, a[at : at + n] / max(rare_tokens, 1), spelled)).sum() for x in SHARES]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SHARES)), pa.int32()), pa.array(gain)], names=["place", "gain"])

    return judged


def _passage_table(spark: SparkSession, path: str) -> DataFrame:
    """passage, a, b, h of the written counts of words and passages."""
    return spark.read.parquet(path).filter(F.col("cls") == PASSAGES).select(F.col("word").alias("passage"), "a", "b", "h")


def _taught(mixer: Mixer, lessons: DataFrame) -> Mixer:
    """mixer with the weights of all tasks, averaged by what they saw, and the sums of their hits."""
    taught = lessons.toArrow()
    if taught.num_rows:
        told = sorted(zip(*(taught.column(c).to_pylist() for c in ("seen", "weights", "hits")), strict=True))
        weights = sum(s * np.frombuffer(w, float) for s, w, _ in told) / sum(s for s, _, _ in told)
        mixer.load(weights, sum(np.frombuffer(h, float) for _, _, h in told))
    return mixer


_LESSON = "seen double, weights binary, hits binary"


def _lessons(rows: DataFrame, count: int, size: int, *columns: str) -> DataFrame:
    """The columns of rows, dealt into lessons of about `size` rows by a hash of all columns and in its order."""
    n = max(1, math.ceil(count / size))
    dealt = rows.withColumn("_key", F.xxhash64(*rows.columns)).withColumn("_lesson", F.pmod(F.col("_key"), F.lit(n)).cast("int"))
    return dealt.repartitionById(n, F.col("_lesson")).sortWithinPartitions("_key", *rows.columns).select(*columns)


def _summed_blocks(blocks: DataFrame, cores: int, to_histories: bool = False) -> DataFrame:
    return blocks.repartition(max(1, min(cores, 64)), "block").sortWithinPartitions("block").mapInArrow(_summer(to_histories), "block int, counts binary")


def _history_table(blocks: DataFrame, bits: int, cores: int) -> np.ndarray:
    """The histories of all slots, from blocks of counts: a byte a slot, made in the tasks."""
    table = np.full((CONTEXTS << bits) * 2 // BLOCK * (BLOCK // 2), histories(np.zeros(1), np.zeros(1))[0], np.uint8).reshape(-1, BLOCK // 2)
    found = _summed_blocks(blocks, cores, True).toArrow()
    for block, h in zip(found.column("block").to_pylist(), found.column("counts"), strict=True):
        table[block] = np.frombuffer(h.as_buffer(), np.uint8)
    return table.reshape(CONTEXTS, -1)


def fit_symbols(texts: DataFrame, coder: Coder, cores: int, taught: int) -> tuple[np.ndarray, Mixer]:
    """Histories of the contexts' slots, and the mixer over them, from texts with their doc_id and fold, `taught` of them of remainder 6.

    One task a core counts, as each holds a table of all slots; the tables are summed block by block.
    """
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(coder)
    counted = lambda some: some.select("text").coalesce(cores).mapInArrow(_context_counts(shared), "block int, counts binary")
    blocks = stash(_summed_blocks(counted(texts.filter(~F.col("fold").isin(2, 6))), cores), "contexts")
    lesson = sc.broadcast((coder, _history_table(blocks, coder.bits, cores)))
    lessons = _lessons(texts.filter("fold = 6").select("doc_id", "text"), taught, LESSON_DOCS, "text").mapInArrow(_symbol_trainer(lesson), _LESSON)
    mixer = _taught(symbol_mixer(), lessons)
    lesson.unpersist()  # workers let go of it
    # what the weights were taught on is counted as well from here on
    table = _history_table(blocks.union(counted(texts.filter("fold = 6"))), coder.bits, cores)
    shared.unpersist()
    return table, mixer


def _slot_counts(words: DataFrame, cores: int) -> np.ndarray:
    """Zeros and ones of every slot by order, each word of words counting once."""
    blocks = words.select("word", "cls").coalesce(cores).mapInArrow(_spelling_counts, "block int, counts binary")
    summed = _summed_blocks(blocks, cores).toArrow()
    tables = np.zeros((2 * SPELLED * SLOTS // BLOCK, BLOCK), np.float32)
    for block, counts in zip(summed.column("block").to_pylist(), summed.column("counts"), strict=True):
        tables[block] = np.frombuffer(counts.as_buffer(), "<f4")
    return tables.reshape(2, SPELLED, SLOTS)


def fit(docs: DataFrame) -> tuple[LanguageModel, DataFrame]:
    """The model, and the written table (word, c) of training counts of all words.

    Word counts are exact and distributed. The driver gets sums, the frequent words, and the
    slot tables, all of fixed bound.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = bounded(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), fold(F.col("doc_id")).alias("fold"))
    ends = rows.groupBy("lang").agg(F.sum((~F.col("fold").isin(2, 6)).cast("long")).alias("a"), F.sum((F.col("fold") == 6).cast("long")).alias("b"))
    ends = stash(ends, "languages")
    top = [r for r in ends.orderBy(F.desc(F.col("a") + F.col("b")), "lang").limit(STATES).collect()]
    all_ends = ends.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    end_a, end_b = int(all_ends["a"] or 0), int(all_ends["b"] or 0)
    languages = [r["lang"] for r in top]

    counted = rows.drop("doc_id").mapInArrow(_counted(languages), "word binary, cls int, a bigint, b bigint, h bigint")
    written = stash_at(counted.groupBy("word", "cls").agg(*(F.sum(c).alias(c) for c in "abh")), "classes")
    by_class = spark.read.parquet(written).filter(F.col("cls") != PASSAGES)
    # the class with most counts, the last of equal ones, as one number: a struct would be sorted for
    most = F.max((F.col("a") + F.col("b")) * (STATES + 1) + F.col("cls"))
    words = stash(by_class.groupBy("word").agg(*(F.sum(c).alias(c) for c in "abh"), (most % (STATES + 1)).cast("int").alias("cls")).withColumn("c", F.col("a") + F.col("b")), "words")

    # by the counted documents alone, and words they have once escape, so that remainder 6 shows how often words escape
    size = F.floor(F.log2("a") * 16).cast("int")
    short = (F.octet_length("word") <= LONGEST) & (F.col("a") > 1)
    steps = words.filter(short).groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()
    held, least = 0, 1 << 20
    for r in sorted(steps, key=lambda r: -r["size"]):
        if held + r["n"] > (1 << SYMBOL_BITS) - FIRST_WORD:
            break
        held, least = held + r["n"], r["size"]
    is_frequent = short & (size >= least)
    frequent = words.filter(is_frequent).select("word", "a", "c").toArrow()
    order = np.lexsort((np.array(frequent.column("word").to_pylist(), object), -frequent.column("a").to_numpy())) if frequent.num_rows else np.empty(0, np.int64)
    known = [frequent.column("word")[i].as_py() for i in order.tolist()]
    place = {w: i + FIRST_WORD for i, w in enumerate(known)}

    sums = words.agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("kinds")).first()
    totals = by_class.groupBy("cls").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    # frequent words are short and few, see above, so they may be broadcast
    listed = spark.createDataFrame(pa.table({"word": pa.array(known, pa.binary())})) if known else words.select("word").limit(0)
    told = by_class.join(F.broadcast(listed), "word", "left_semi").select("word", "cls", "a", "b").toArrow()
    states = len(languages) + 1
    folds = np.zeros((2, states, 1 << SYMBOL_BITS))
    at = np.array([place[w] for w in told.column("word").to_pylist()], np.int64)
    cls = told.column("cls").to_numpy().astype(np.int64)
    for k, c in enumerate("ab"):
        np.add.at(folds[k], (cls, at), told.column(c).to_numpy())
        for r in totals:
            folds[k, r["cls"], ESCAPE] = r[c] - folds[k, r["cls"]].sum()
        for i, r in enumerate(top):
            folds[k, i + 1, END] = r[c]
        folds[k, 0, END] = (end_a, end_b)[k] - folds[k, 1:, END].sum()
    both = folds.sum(0)
    share = both[1:] / np.maximum(both.sum(0), 1)
    classes = np.where((both.sum(0) >= 4) & (share.max(0) >= 0.8), share.argmax(0) + 1, 0).astype(np.int64) if states > 1 else np.zeros(1 << SYMBOL_BITS, np.int64)
    classes[:FIRST_WORD] = 0
    folds[:, 0] = folds.sum(1)
    symbols = SymbolModel.fit(folds[0], folds[1])
    tokens = int(sums["c"] or 0) + end_a + end_b
    n_symbols = FIRST_WORD + len(known)
    coder = Coder(pa.array(known, pa.binary()), classes[:n_symbols], PrefixCode.of(symbols.table[:, :n_symbols]), slot_bits(tokens))
    table, mixer = fit_symbols(rows, coder, cores, end_b)

    told_passages = _passage_table(spark, written).agg(F.sum(F.col("a") + F.col("b")).alias("n"), F.sum("b").alias("b"), F.sum(F.when(F.col("a") > 0, F.col("b"))).alias("known")).first()
    known_share = ((told_passages["known"] or 0) + 1) / ((told_passages["b"] or 0) + 20)

    # a word that escapes looks like one that is new to the counts, so each word is spelled once, and new ones teach
    tables = _slot_counts(words.filter("a > 0"), cores)
    spelling = ByteModel.of(tables[0], tables[1])
    shared = spark.sparkContext.broadcast(spelling)
    new = words.filter("a = 0 and b > 0").select("word", "cls")
    lessons = _lessons(new, new.count(), LESSON_WORDS, "word", "cls")
    _taught(spelling.mixer, lessons.mapInArrow(_mixer_trainer(shared), _LESSON))
    rare = words.filter(~is_frequent)
    shared.unpersist()
    in_rare = rare.agg(F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    shared = spark.sparkContext.broadcast(spelling)
    judged = rare.filter("b > 0").select("word", "cls", "a", "b").coalesce(cores).mapInArrow(_share_judge(shared, int(in_rare["a"] or 0)), "place int, gain double")
    gains = np.zeros(len(SHARES))
    for r in judged.groupBy("place").agg(F.sum("gain").alias("gain")).collect():
        gains[r["place"]] = r["gain"]
    shared.unpersist()
    share = float(SHARES[gains.argmax()]) if in_rare["a"] else 0.0
    tables += _slot_counts(words.filter("a = 0 and b > 0"), cores)
    taught_mixer, spelling = spelling.mixer, ByteModel.of(tables[0], tables[1])
    spelling.mixer = taught_mixer
    counts = frequent.column("c").to_numpy()[order].astype(np.int64)
    model = LanguageModel(counts, symbols, coder, table, mixer, spelling, end_a + end_b, tokens, int(sums["kinds"] or 0) + (end_a + end_b > 0), written, int(told_passages["n"] or 0), known_share, share, int(in_rare["c"] or 0))
    return model, words.select("word", "c")


# ---- Spark: scores


#: What only a text's own row has, packed: in a shuffled row an absent one takes eight bytes.
_DOC = np.dtype([("id", "<i8"), ("no_id", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("bytes", "<i8")])
#: rare: words that escape, each closed with a space, which no word holds; states: a byte for each of them.
_FIRST = {"passage": pa.binary(), "row": pa.int64(), "times": pa.int32(), "own": pa.int32(), "others": pa.int32(), "score": pa.float64(), "rare": pa.binary(), "states": pa.binary(), "doc": pa.binary()}
_FIRST_DDL = "passage binary, row bigint, times int, own int, others int, score double, rare binary, states binary, doc binary"
#: how: times, the state and whether the word is scored, in one number.
_WORD = {"word": pa.binary(), "how": pa.int64(), "row": pa.int64(), "score": pa.float64(), "doc": pa.binary()}
_WORD_DDL = "word binary, how bigint, row bigint, score double, doc binary"
_ROW = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "bytes": pa.int64()}
_ROW_DDL = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, bytes bigint"
#: Rows of words that are summed by text before they leave a task.
SUMMED = 1 << 19


def _batch(types: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """Columns that are not given are null."""
    n = len(columns["row"])
    arrays = [pa.nulls(n, t) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _parts(data: pa.Buffer | np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of data, as binary, that end there."""
    offsets = np.concatenate([[0], ends])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch has 2 GB of escaped words")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _bytes_of(values: pa.Array) -> np.ndarray:
    """The bytes of all values in a row, absent ones being empty."""
    values = pc.fill_null(values, b"")
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _closed(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of words of these sizes, each word closed with a space, as one value for each run."""
    closed = pc.binary_join_element_wise(words, pa.scalar(b"", pa.binary()), b" ")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(closed).to_numpy(zero_copy_only=False).astype(np.int64))])
    return _parts(_bytes_of(closed), ends[np.cumsum(sizes)])


def _opened(closed: pa.Array) -> pa.Array:
    """All words of _closed() values."""
    data = _bytes_of(closed)
    stop = np.flatnonzero(data == 32)
    return _parts(data[data != 32], stop - np.arange(len(stop)))


def _first_pass(shared, own: bool):
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text one row with what its symbols give as far as the corpus has none of its passages, and one for each passage.

        A passage's row has the score of its symbols where it first stands, and the words that escape there;
        whether it is known, and how likely the words are, is told by the joins. Short passages are in the text's row.
        """
        m: LanguageModel = shared.value
        base = m.base(m.counts)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            texts, ids, rows, fold_ = column(batch, "text"), get("doc_id"), get("row").to_numpy(zero_copy_only=False), _fold_places(batch)
            for at, n in text_slices(texts, SLICE):
                part, row, held_out = texts.slice(at, n), rows[at : at + n], fold_[at : at + n] == 2
                w, symbol, t = tokens_of(m.coder, part)
                vocab = w.vocab.cast(pa.binary())
                place, value = symbol - FIRST_WORD, np.zeros(len(symbol))
                frequent = place >= 0
                value[frequent] = base[place[frequent]]
                seen = np.zeros(len(symbol), bool)
                seen[frequent] = m.counts[place[frequent]] > 0
                add = lambda of_words: np.bincount(w.parent, weights=of_words[w.codes] if len(w.codes) else None, minlength=n)  # noqa: B023, E731
                p = passages_of(w, t.place, t.first)
                each = log10_symbols(m.coder, m.table, m.mixer, t)
                of_passage = np.add.reduceat(each, p.begin)
                escapes = np.flatnonzero(t.symbol == ESCAPE)
                code = np.full(len(t.symbol), -1, np.int64)
                code[t.place] = w.codes
                rare_in = np.searchsorted(p.begin, escapes, side="right") - 1
                long = p.size >= LEAST
                # each long passage of a text once, where it first stands
                key = p.key.view(np.uint64) ^ mixed(p.text.astype(np.uint64))
                _, once, where, times = np.unique(np.where(long, key, 0), return_index=True, return_inverse=True, return_counts=True)
                leads = np.zeros(len(key), bool)
                leads[once] = True
                leads &= long
                flag = math.log10(1 - m.known_share)
                # as if the corpus had none of its passages, each once; what is else is told by the joins
                apart = ~long | leads
                unknown = np.bincount(p.text[apart], weights=of_passage[apart] + flag, minlength=n)
                sizes = np.bincount(p.text[rare_in[~long[rare_in]]], minlength=n)
                row_keys = _as_bytes(mixed(row.astype(np.uint64) + np.uint64(1 << 60)).view(np.int64))
                listed = escapes[~long[rare_in]]
                document = np.zeros(n, _DOC)
                document["id"], document["no_id"] = pc.fill_null(ids.slice(at, n), 0).to_numpy(zero_copy_only=False), pc.is_null(ids.slice(at, n)).to_numpy(zero_copy_only=False)
                document["held_out"], document["n_tokens"], document["n_known"] = held_out, w.counts + 1, add(seen.astype(float)).astype(np.int64) + (m.end_count > 0)
                document["base"], document["bytes"] = add(value) + m.base(np.array(m.end_count)), pc.binary_length(part).to_numpy(zero_copy_only=False)
                states = t.state.astype(np.uint8)
                yield _batch(
                    _FIRST, passage=row_keys, row=row, times=np.zeros(n), own=np.zeros(n), others=np.zeros(n), score=unknown, rare=_closed(vocab.take(pa.array(code[listed])), sizes), states=_parts(states[listed], np.cumsum(sizes)),
                    doc=_parts(document.view(np.uint8), _DOC.itemsize * np.arange(1, n + 1)),
                )
                others = np.bincount(p.text[long], minlength=n)
                lead = np.flatnonzero(leads)
                count, text = times[where[lead]], p.text[lead]
                chosen = leads[rare_in]
                sizes = np.bincount(rare_in[chosen], minlength=len(key))[lead]
                listed = escapes[chosen]
                rare, spoken = _closed(vocab.take(pa.array(code[listed])), sizes), _parts(states[listed], np.cumsum(sizes))
                for begin in range(0, len(lead), 20_000):
                    some = slice(begin, begin + 20_000)
                    yield _batch(_FIRST, passage=_as_bytes(p.key[lead[some]]), row=row[text[some]], times=count[some], own=np.where(held_out[text[some]] | (not own), 0, count[some]), others=others[text[some]], score=of_passage[lead[some]], rare=rare[some], states=spoken[some])

    return passed


def _resolve(shared):
    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word that escapes, the first of a passage with what the passage adds to its text's score; c: the passage's training count."""
        m: LanguageModel = shared.value
        flag = math.log10(1 - m.known_share)
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            number = lambda c: pc.fill_null(get(c), 0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            times, others, score, row = number("times").astype(np.int64), number("others"), number("score"), number("row")
            count = np.where(times > 0, np.maximum(number("c") - number("own"), 0), 0)
            known, again = np.flatnonzero(count > 0), np.flatnonzero((count == 0) & (times > 1))
            total = np.where(times > 0, 0, score)
            total[known] = m.passage(count[known], times[known], others[known]) - score[known] - flag
            total[again] = m.passage(np.ones(len(again), np.int64), times[again] - 1, others[again])
            words, sizes = _opened(get("rare")), pc.binary_length(pc.fill_null(get("states"), b"")).to_numpy(zero_copy_only=False).astype(np.int64)
            state = _bytes_of(get("states")).astype(np.int64)
            # a row without escapes that has something to say gets a key that no word is (no word holds a space), spread over the tasks
            none = np.flatnonzero((sizes == 0) & ((times == 0) | (total != 0)))
            markers = pa.array([b" " + int(r).to_bytes(8, "big", signed=True) + int(i).to_bytes(4, "big") for i, r in zip(none.tolist(), row[none].tolist(), strict=True)], pa.binary())
            owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), none])
            lead = np.concatenate([(np.cumsum(sizes) - sizes)[sizes > 0], len(words) + np.arange(len(none))])
            carried = np.zeros(len(owner))
            carried[lead] = total[owner[lead]]
            how = np.zeros(len(owner), np.int64)
            in_text = owner[: len(words)]
            how[: len(words)] = np.maximum(times[in_text], 1) << 6 | state << 1 | (count[in_text] == 0)
            # a passage's row has no document
            first = np.full(len(owner), -1)
            first[lead] = owner[lead]
            document = get("doc").take(pa.array(first, mask=first < 0))
            yield _batch(_WORD, word=pa.concat_arrays([words, markers]), how=how, row=row[owner], score=carried, doc=document)

    return resolved


def _summed_rows(waiting: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(row, n_known, base, score) of words, summed by row."""
    if waiting:
        rows, *values = (np.concatenate(x) for x in zip(*waiting, strict=True))
        rows, place = np.unique(rows, return_inverse=True)
        known, base, score = (np.bincount(place, weights=x, minlength=len(rows)) for x in values)
        for at in range(0, len(rows), 100_000):
            some = slice(at, at + 100_000)
            yield _batch(_ROW, row=rows[some], n_known=known[some].astype(np.int64), base=base[some], score=score[some])


def _second_pass(shared):
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of words get their base and spelling scores, summed by text; each word of a batch is spelled once for a state."""
        m: LanguageModel = shared.value
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            number = lambda c: pc.fill_null(get(c), 0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            how = number("how")
            times, scored = how >> 6, how & 1
            words = get("word").dictionary_encode()
            code, vocab = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            # the kinds of (word, state)
            used, kind = np.unique(code.astype(np.int64) << 5 | how >> 1 & 31, return_inverse=True)
            wanted = np.bincount(kind, weights=scored, minlength=len(used)) > 0
            used, value = used[wanted], np.zeros(len(used))
            spelled, places = vocab.take(pa.array(used >> 5)), np.flatnonzero(wanted)
            for at, n in _runs(spelled):
                value[places[at : at + n]] = m.spelling.log10_probability(spelled.slice(at, n), used[at : at + n] & 31)
            c, row = number("c"), number("row")
            waiting.append((row, np.where(c > 0, times, 0), np.where(times > 0, times * m.base(c), 0), number("score") + np.where(scored > 0, m.escaped(c, value[kind]), 0)))
            own = np.flatnonzero(pc.is_valid(get("doc")).to_numpy(zero_copy_only=False))
            document = _bytes_of(get("doc")).view(_DOC)
            yield _batch(_ROW, row=row[own], doc_id=pa.array(document["id"], mask=document["no_id"]), **{c: np.ascontiguousarray(document[c]) for c in ("held_out", "n_tokens", "n_known", "base", "bytes")}, score=np.zeros(len(own)))
            if sum(len(w[0]) for w in waiting) >= SUMMED:
                yield from _summed_rows(waiting)
                waiting = []
        yield from _summed_rows(waiting)

    return passed


def score(docs: DataFrame, model: LanguageModel, words: DataFrame, own: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    own: the model was fitted on docs, so that training documents' own passages are taken off the counts.
    Symbols are scored where the text is read. The passages of a text meet their counts in one join,
    the words that escape, by then a row each, in a second one; texts are not shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold(F.col("doc_id")).alias("fold"), F.monotonically_increasing_id().alias("row"))
    first = rows.mapInArrow(_first_pass(shared, own), _FIRST_DDL)
    counted = _passage_table(spark, model.passages).withColumn("c", F.col("a") + F.col("b")).filter("c > 0")
    counted = counted.filter("c + h > 1") if own else counted  # what only one document has, itself may not use
    resolved = first.join(counted.select("passage", "c"), "passage", "left").mapInArrow(_resolve(shared), _WORD_DDL)
    joined = resolved.join(words.filter("c > 0"), "word", "left")
    second = joined.mapInArrow(_second_pass(shared), _ROW_DDL)
    per = second.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.max("bytes").alias("bytes"))
    bits = -F.col("score") * math.log2(10) / F.greatest("bytes", F.lit(1))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
