"""Symbols bit by bit: a prefix code, hashed contexts of the tokens before, and their gated mixing.

A symbol is a path through a prefix code's tree. Each bit of it is predicted by what the language
state says, and by counts under hashed contexts of the tokens before: the last word, the last two
words, and the last three bytes with the state. A word that is not among the `TOP` most frequent
stands as a context for all words with its last three bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, mixed, split_words

ESCAPE, END, FIRST_WORD = 0, 1, 2
TOP = 4096
#: Hashed contexts: last word, last two words, last bytes with the state.
CONTEXTS = 3
#: Slots of each context: SLOT_BITS[0] bits on small corpora, up to SLOT_BITS[1].
SLOT_BITS = (14, 21)
#: Decisions that are worked on at once.
_RUN = 1 << 17
KEY_BITS = 30
#: Tokens that are counted at once.
_WAIT = 1 << 20
_NODE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A history's sureness: where the number of decisions that a slot has seen reaches these.
_SURE = (1, 2, 4, 8, 32, 128, 1024)
_MIDDLE = np.array([0, 1, 2.5, 5.5, 16, 64, 360, 3000], np.float32)


def slot_bits(tokens: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(tokens, 1))), *SLOT_BITS))


def histories(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """One byte for the counts of a slot: three bits of sureness, five of log-odds in halves."""
    odds = np.rint(2 * np.log((ones + 0.02) / (zeros + 0.02)))
    return (np.searchsorted(_SURE, zeros + ones, side="right") << 5 | (np.clip(odds, -16, 15) + 16).astype(np.int64)).astype(np.uint8)


def counts_of(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """About the zeros and ones that a history stands for."""
    n, odds = _MIDDLE[history >> 5], (history & 31).astype(np.float32) / 2 - 8
    ones = n / (1 + np.exp(-odds))
    return (n - ones).astype(np.float32), ones.astype(np.float32)


#: Log-odds of a node, in thirds, as they are a prior of counts.
_PRIORS = np.arange(-36, 37) / 3


def _added() -> np.ndarray:
    """What a history adds to the log-odds that are its prior, one count strong: a row for each history."""
    zeros, ones = (c[:, None].astype(float) for c in counts_of(np.arange(256, dtype=np.uint8)))
    p = 1 / (1 + np.exp(-_PRIORS))
    return (np.log((ones + p) / (zeros + 1 - p)) - _PRIORS).astype(np.float32)


_ADDED = _added().ravel()


@dataclass
class PrefixCode:
    """Every symbol's way through a binary tree, frequent ones first, and the log-odds of each node by state."""

    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: np.ndarray
    #: Of odds, the place in _PRIORS.
    priors: np.ndarray

    @staticmethod
    def of(table: np.ndarray) -> PrefixCode:
        """table: log10 P(symbol) for each state (first: none), of two symbols at least; the code is the first row's Huffman code."""
        p = 10.0 ** table.astype(float).T
        n, states = p.shape
        order = np.argsort(p[:, 0], kind="stable").tolist()
        waiting, made = p[order, 0].tolist(), []
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        children = np.zeros((n - 1, 2), np.int64)
        leaf = inner = 0
        for node in range(n - 1):
            weight = 0.0
            for s in (0, 1):
                if leaf < n and (inner == len(made) or waiting[leaf] <= made[inner]):
                    child, weight, leaf = order[leaf], weight + waiting[leaf], leaf + 1
                else:
                    child, weight, inner = n + inner, weight + made[inner], inner + 1
                up[child], side[child], children[node, s] = n + node, s, child
            made.append(weight)
        sums = np.concatenate([p, np.zeros((n - 1, states))])
        for node in range(n - 1):
            sums[n + node] = sums[children[node, 0]] + sums[children[node, 1]]
        odds = np.ascontiguousarray(np.clip(np.log(sums[children[:, 1]] / sums[children[:, 0]]), -12, 12).T, np.float32)
        now, alive, steps = np.arange(n), np.arange(n), []
        while len(alive):
            above = up[now[alive]]
            steps.append((alive, above - n, side[now[alive]]))
            now[alive] = above
            alive = alive[above != 2 * n - 2]
        sizes = np.zeros(n, np.int64)
        for symbols, _, _ in steps:
            sizes[symbols] += 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        nodes, bits = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.uint8)
        for back, (symbols, node, bit) in enumerate(steps):
            at = starts[symbols + 1] - 1 - back
            nodes[at], bits[at] = node, bit
        return PrefixCode(starts, nodes, bits, odds, np.rint(odds * 3 + 36).astype(np.uint8))

    def runs(self, symbol: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some symbols at a time: which, where the decisions of each begin, how many it has, and the places of all in nodes and bits."""
        size = self.starts[symbol + 1] - self.starts[symbol]
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + _RUN, side="right")))
            some = slice(at, to)
            begin = upto[some] - size[some] - base
            path = np.arange(int(upto[to - 1] - base))
            path += np.repeat(self.starts[symbol[some]] - begin, size[some])
            yield some, begin, size[some], path
            at = to


def hashed(context: int, key: np.ndarray) -> np.ndarray:
    return mixed(key.astype(np.uint64) + np.uint64((context + 1) << 50))


@dataclass
class Tokens:
    """The tokens of some texts, each text closed with END: symbols, states, contexts."""

    symbol: np.ndarray
    state: np.ndarray
    #: What each context's hash is of, below 2^KEY_BITS.
    keys: tuple[np.ndarray, ...]
    #: Where each word stands among the tokens, and each text's first token; the last entry is their number.
    place: np.ndarray
    first: np.ndarray

    @functools.cached_property
    def contexts(self) -> tuple[np.ndarray, ...]:
        return tuple(hashed(k, key) for k, key in enumerate(self.keys))


def last_bytes(words: pa.Array) -> np.ndarray:
    """The last three bytes of each word as one number."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64) if words.buffers()[2] else np.zeros(1, np.int64)
    out = np.zeros(len(words), np.int64)
    for back in (1, 2, 3):
        at = ends[1:] - back
        out |= np.where(at >= ends[:-1], data[np.maximum(at, 0)], 0) << (8 * (back - 1))
    return out


def states_before(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each token, from the tokens' classes (0: says nothing): the last telling one of its text."""
    n = len(classes)
    told = np.maximum.accumulate(np.where(classes > 0, np.arange(n), -1)) if n else np.empty(0, np.int64)
    told = np.concatenate([[-1], told[:-1]]) if n else told
    text_first = np.repeat(first[:-1], np.diff(first))
    return np.where(told >= text_first, classes[told], 0) if n else told


@dataclass
class Coder:
    """Frequent words as symbols, with the state that each speaks for, and their code."""

    #: binary, in the order of their symbols
    words: pa.Array
    classes: np.ndarray
    code: PrefixCode
    bits: int

    def tokens(self, w: Words, symbol: np.ndarray) -> Tokens:
        """symbol: of each word of w.vocab, ESCAPE if it has none."""
        texts = w.n_texts
        place = np.arange(len(w.codes)) + w.parent
        first = np.concatenate([[0], np.cumsum(w.counts + 1)]).astype(np.int64)
        n = int(first[-1])
        tail = last_bytes(w.vocab)
        kind = np.where((symbol >= FIRST_WORD) & (symbol < TOP), symbol, TOP + (mixed(tail.astype(np.uint64)) % np.uint64(TOP)).astype(np.int64))
        full = lambda values, at_end: _laid(values, w.codes, place, n, at_end)
        all_symbols, kinds, tails = full(symbol, END), full(kind, END), full(tail, 0)
        starts = first[:-1]
        one, tail_before = np.concatenate([[0], kinds[:-1]])[:n], np.concatenate([[0], tails[:-1]])[:n]
        two = np.concatenate([[0, 0], kinds[:-2]])[:n]
        one[starts], tail_before[starts], two[starts] = 0, 0, 0
        two[starts[np.diff(first) > 1] + 1] = 0
        state = states_before(self.classes[all_symbols], first) if texts else np.empty(0, np.int64)
        keys = (one, (two << 13) + one, (tail_before << 5) + state)
        return Tokens(all_symbols, state, keys, place, first)

    def runs(self, t: Tokens) -> Iterator[tuple[slice, np.ndarray, Decisions]]:
        """(tokens, where their decisions begin, decisions) for some tokens at a time."""
        code = self.code
        for tokens, begin, size, path in code.runs(t.symbol):
            yield tokens, begin, Decisions(self, t, tokens, size, code.nodes.take(path, mode="clip"), code.bits.take(path, mode="clip"))


def _laid(values: np.ndarray, codes: np.ndarray, place: np.ndarray, n: int, at_end: int) -> np.ndarray:
    out = np.full(n, at_end, np.int64)
    out[place] = values[codes] if len(codes) else 0
    return out


@dataclass
class Decisions:
    coder: Coder
    t: Tokens
    #: The tokens, and how many decisions each of them has.
    tokens: slice
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def slots(self) -> Iterator[np.ndarray]:
        """For each context the slots of all decisions."""
        node, shift = self.node.astype(np.uint64) * _NODE, np.uint64(64 - self.coder.bits)
        for k in range(CONTEXTS):
            h = np.repeat(self.t.contexts[k][self.tokens], self.size)
            h ^= node
            h *= _SPREAD
            h >>= shift
            yield h.view(np.int64)

    def inputs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the mixer, gate and cell. The first input is the state's log-odds, the others are what
        each context's counts add to it, with the state's prediction as their prior."""
        code = self.coder.code
        at = np.repeat(self.t.state[self.tokens] * code.odds.shape[1], self.size)
        at += self.node
        prior = code.priors.ravel().take(at, mode="clip")
        inputs, cell = np.empty((1 + CONTEXTS, len(at)), np.float32), np.zeros(len(at), np.uint8)
        code.odds.ravel().take(at, mode="clip", out=inputs[0])
        for k, slots in enumerate(self.slots()):
            history = table[k].take(slots, mode="clip")
            place = history.astype(np.uint16)  # len(_ADDED) is below 2^16
            place *= len(_PRIORS)
            place += prior
            _ADDED.take(place, mode="clip", out=inputs[k + 1])
            history >>= 5
            if k < CONTEXTS - 1:
                cell <<= 3
                cell |= history
        cell = cell.astype(np.int64)
        return inputs.T, cell << 3 | history, cell


@dataclass
class Seen:
    """How often each slot of the contexts has seen a zero and a one. Up to `_WAIT` tokens wait, then equal ones in equal contexts are counted as one."""

    coder: Coder
    tables: np.ndarray = field(init=False)
    waiting: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    n: int = 0

    def __post_init__(self) -> None:
        self.tables = np.zeros((CONTEXTS, 2 << self.coder.bits), np.float32)

    def add(self, t: Tokens) -> None:
        self.waiting.append(tuple(t.symbol << KEY_BITS | key for key in t.keys))
        self.n += len(t.symbol)
        if self.n >= _WAIT:
            self.count()

    def count(self) -> None:
        code, shift = self.coder.code, np.uint64(64 - self.coder.bits)
        for k in range(CONTEXTS if self.n else 0):
            pairs = np.sort(np.concatenate([w[k] for w in self.waiting]))
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            times = np.diff(np.append(first, len(pairs))).astype(np.float32)
            pairs = pairs[first]
            contexts = hashed(k, pairs & ((1 << KEY_BITS) - 1))
            for some, _, size, path in code.runs(pairs >> KEY_BITS):
                h = code.nodes.take(path, mode="clip").astype(np.uint64)
                h *= _NODE
                h ^= np.repeat(contexts[some], size)
                h *= _SPREAD
                h >>= shift
                slots = h.view(np.int64)
                slots <<= 1
                slots |= code.bits.take(path, mode="clip")
                np.add.at(self.tables[k], slots, np.repeat(times[some], size))
        self.waiting, self.n = [], 0


def symbols_of(w: Words, known: pa.Array) -> np.ndarray:
    """The symbol of each word of w.vocab."""
    found = pc.index_in(w.vocab.cast(pa.binary()), known)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + FIRST_WORD if len(w.vocab) else np.empty(0, np.int64)


def tokens_of(coder: Coder, texts: pa.Array) -> tuple[Words, np.ndarray, Tokens]:
    """Words, symbols of the vocabulary and tokens of texts without nulls."""
    w = split_words(texts, lower=True)
    symbol = symbols_of(w, coder.words)
    symbol = np.where(symbol < FIRST_WORD, ESCAPE, symbol)
    return w, symbol, coder.tokens(w, symbol)
