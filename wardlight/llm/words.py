"""Word positions and hashes of whole texts, vectorised over blocks of texts.

Every word has two 64-bit hashes. Its bytes are taken in eights; each eight, combined with its place
in the word and a seed, is scrambled before the sum, so no algebraic relation between
bytes carries over, and the hashes have unrelated seeds. The first one is exact for words of
up to eight bytes but for the final scrambling of their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}
#: What is left of eight bytes by how many belong to the word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that sums of products hash well."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(count: int, seed: int) -> np.ndarray:
    """Odd multipliers, the same on every machine."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between blocks."""
    if len(_powers.get("up", ())) < size:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(max(size, 1 << 16), base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:size], _powers["down"][:size]


class Pieces:
    """Words cut into eights of bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.lengths = (ends - starts).astype(np.int64)
        counts = (self.lengths + 7) >> 3
        self.single = not len(counts) or counts.max() == 1
        self.firsts = np.cumsum(counts) - counts
        at, left, self.place = starts, self.lengths, np.zeros(1, np.uint64)
        if not self.single:
            place = np.arange(counts.sum()) - np.repeat(self.firsts, counts)
            at = np.repeat(starts, counts) + 8 * place
            left = np.minimum(np.repeat(ends, counts) - at, 8)
            self.place = place.astype(np.uint64)
        self.values = _eights(data, at) & _MASKS[left]

    def hashes(self, number: int) -> np.ndarray:
        """The words' hashes under one of the seeds."""
        seed = odd_constants(2, 50)[number]
        places = mixed(np.arange(1, int(self.place.max(initial=0)) + 2, dtype=np.uint64) * seed)
        scrambled = mixed(self.values ^ places[self.place.astype(np.int64)])
        if not self.single:
            scrambled = np.add.reduceat(scrambled, self.firsts)
        return mixed(scrambled + self.lengths.astype(np.uint64) * seed)


@dataclass
class Words:
    """The words of a block of texts: bytes, word bounds, hashes, and words per text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    firsts: np.ndarray  # number of each text's first word

    @cached_property
    def hashes(self) -> np.ndarray:
        return self._pieces.hashes(0)

    @cached_property
    def others(self) -> np.ndarray:
        """Hashes under another seed."""
        return self._pieces.hashes(1)

    @cached_property
    def _pieces(self) -> Pieces:
        return Pieces(self.data, self.starts, self.ends)

    @property
    def both(self) -> np.ndarray:
        """One number from both hashes of each word."""
        return mixed(self.hashes + mixed(self.others))

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _eights(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte lowest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))[at].view("<u8").reshape(-1)


def tokenise(texts: list[str], lower: bool = False) -> Words:
    r"""Words `[^\x20\x09-\x0D]+` of the texts; `lower` folds A-Z to a-z first."""
    encoded = [text.encode("utf-8", "replace") for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.empty(0, np.int64)
    upto = np.searchsorted(starts, text_ends)
    counts = np.diff(upto, prepend=0)
    return Words(data, starts, ends, counts, upto - counts)


def window_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of every `length` consecutive values, wherever it starts."""
    if len(hashes) < length:
        return np.empty(0, np.uint64)
    count = len(hashes) - length + 1
    total = np.zeros(count, np.uint64)
    for k, factor in enumerate(odd_constants(length, seed)):
        total += hashes[k : k + count] * factor
    return mixed(total)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words folded to lower case.

    A text with fewer words than `size` has its whole sequence as one shingle; one
    without words has none. A shingle's hash covers both hashes of its words.
    """
    words = tokenise(texts, lower=True)
    both = words.both
    windows = window_hashes(both, size, seed=5)
    found = []
    for first, count in zip(words.firsts.tolist(), words.counts.tolist(), strict=True):
        if count >= size:
            found.append(np.unique(windows[first : first + count - size + 1]))
        elif count:
            found.append(window_hashes(both[first : first + count], count, seed=100 + count))
        else:
            found.append(np.empty(0, np.uint64))
    return found
