"""Words of whole texts as integer codes, for a slice of an Arrow column at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """The words of some texts, in order: codes[i] is the place in vocab of word i, parent[i] its text."""

    codes: np.ndarray
    parent: np.ndarray
    vocab: pa.Array
    n_texts: int

    @property
    def counts(self) -> np.ndarray:
        """Words in each text."""
        return np.bincount(self.parent, minlength=self.n_texts)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts without nulls; lower changes A-Z alone."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = flat.dictionary_encode()
    codes, vocab = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
    if empty >= 0:  # at the ends of a text
        held = codes != empty
        codes, parent = codes[held], parent[held]
    return Words(codes, parent, vocab, len(texts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(keys: np.ndarray, parent: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` successive keys within one text, and where each window begins.

    keys: a 64-bit hash for each word.
    """
    n = len(keys) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ keys[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = parent[:n] == parent[size - 1 :]
    return mixed(h[inside]), np.flatnonzero(inside)


def vocab_hashes(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))
