"""Search for benchmark items in documents, by SimHash over item-sized windows.

An item is the multiset of its five-word shingles (lower-cased A-Z; an item of fewer
words is one shingle). A document window of as many words as the item is compared
with it by the weighted Jaccard similarity: shared occurrences over all occurrences.
Documents shorter than an item are compared as a whole.

An item is compared with windows that start at one of its own shingles only; this
loses nothing, as moving a window's start to its first shared shingle, or to the last place
where the window fits, keeps every shared shingle inside. Their 256-bit SimHash
fingerprints are compared by 32 blocks of 8 bits, each with all values one bit
away: by the pigeonhole principle that finds every item within 63 bits. So wide a radius
lets most fingerprints pass the blocks; that few pairs get there is due to the shingles. Two
multisets of similarity 0.8 differ in 39 bits on average with a deviation of 6, so one in a
hundred thousand is lost at the threshold and none in practice above it.
Every candidate is verified on the exact multisets.

The benchmark is read in blocks of at most `BLOCK_WORDS` words (or one item), each one pass
over the documents, so what is sent to the tasks is bounded.

Null and empty texts and items match nothing. An item without an id is reported with a null id. Repeated items and rows are reported one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import mapped, text_blocks
from wardlight.llm.words import mixed, odd_constants, tokenise, window_hashes

SHINGLE = 5
LEAST_SIMILARITY = 0.8
BITS = 256
RADIUS = 63
#: Pairs whose fingerprints are compared at a time.
PAIRS = 1 << 16
#: Words of the benchmark that are sent to the tasks at a time, at most.
BLOCK_WORDS = 200_000


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """The shingles of a word sequence, in order."""
    if 0 < len(hashes) < SHINGLE:
        return window_hashes(hashes, len(hashes), seed=100 + len(hashes))
    return window_hashes(hashes, SHINGLE, seed=5)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 per shingle."""
    lanes = [mixed(shingles + factor) for factor in odd_constants(BITS // 64, 900)]
    bits = np.unpackbits(np.column_stack(lanes).view(np.uint8), axis=1)
    return bits.astype(np.int16) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Packed SimHash bits of rows of summed signs."""
    return np.packbits(sums > 0, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    kinds, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a = np.bincount(which[: len(a)], minlength=len(kinds))
    in_b = np.bincount(which[len(a) :], minlength=len(kinds))
    return float(np.minimum(in_a, in_b).sum() / max(np.maximum(in_a, in_b).sum(), 1))


class Items:
    """A block of the benchmark: its shingles, and per size the blocks of its fingerprints."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        words = tokenise(texts, lower=True)
        bounds = zip(words.firsts.tolist(), words.counts.tolist(), strict=True)
        self.ids = pa.array(ids, pa.int64())
        self.shingles = [_shingles(words.both[f : f + c]) for f, c in bounds]
        self.sizes = words.counts
        own = [np.unique(s) for s in self.shingles]
        self.keys = np.concatenate(own) if own else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(s) for s in own])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.items = self.keys[order], item[order]
        self.tables: dict[int, tuple] = {}
        #: Sizes below a shingle, which are looked up as whole windows.
        self.short = sorted({int(s) for s in self.sizes if 0 < s < SHINGLE})

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of this many words, in order, and their fingerprints."""
        if size not in self.tables:
            members = np.flatnonzero(self.sizes == size)
            prints = fingerprint(np.array([_signs(self.shingles[i]).sum(axis=0) for i in members]))
            self.tables[size] = members, prints
        return self.tables[size]

    def _pairs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and the places of one document's windows that start at a shingle of theirs."""
        items, places = [], []
        for length in {min(SHINGLE, len(hashes)), *(n for n in self.short if n < len(hashes))}:
            shingles = window_hashes(hashes, length, seed=SHINGLE if length == SHINGLE else 100 + length)
            left = np.searchsorted(self.keys, shingles, side="left")
            held = np.searchsorted(self.keys, shingles, side="right") - left
            hit = np.repeat(np.arange(len(shingles)), held)
            spot = np.arange(len(hit)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(left, held)
            items.append(self.items[spot])
            places.append(np.maximum(np.minimum(hit, len(hashes) - self.sizes[self.items[spot]]), 0))
        pairs = np.unique(np.column_stack([np.concatenate(items), np.concatenate(places)]), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window per item, for one document's words."""
        items, places = self._pairs(hashes)
        best: dict[int, tuple[float, int]] = {}
        for size in np.unique(self.sizes[items]).tolist():
            members, prints = self.table(size)
            mine = np.flatnonzero(self.sizes[items] == size)
            at, which = np.unique(places[mine], return_inverse=True)
            member = np.searchsorted(members, items[mine])
            windows = [_shingles(hashes[p : p + size]) for p in at.tolist()]
            own = fingerprint(np.array([_signs(w).sum(axis=0) for w in windows]))
            for begin in range(0, len(mine), PAIRS):
                part = slice(begin, begin + PAIRS)
                apart = np.bitwise_count(own[which[part]] ^ prints[member[part]])
                near = (apart <= 1).any(axis=1) & (apart.sum(axis=1, dtype=np.int64) <= RADIUS)
                for pair in (begin + np.flatnonzero(near)).tolist():
                    item = int(items[mine[pair]])
                    value = similarity(windows[which[pair]], self.shingles[item])
                    if value >= least and value > best.get(item, (0.0, 0))[0]:
                        best[item] = value, int(at[which[pair]])
        return [(item, value, place) for item, (value, place) in sorted(best.items())]


def _search(items: Items, least: float):
    """Matches (doc_id, item_id, similarity, first_word, n_words) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            owner, found = [], []
            for start, end in text_blocks(texts):
                words = tokenise(texts[start:end], lower=True)
                windows = window_hashes(words.both, SHINGLE, seed=5)
                known = np.cumsum(np.r_[0, np.isin(windows, items.keys)])
                bounds = zip(words.firsts.tolist(), words.counts.tolist(), strict=True)
                for number, (first, count) in enumerate(bounds):
                    whole = count >= SHINGLE and not items.short
                    if not count or whole and known[first + count - SHINGLE + 1] == known[first]:
                        continue  # no word, or no shingle of any item
                    for match in items.matches(words.both[first : first + count], least):
                        owner.append(start + number)
                        found.append(match)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    items.ids.take(pa.array([i for i, _, _ in found], pa.int64())),
                    pa.array([value for _, value, _ in found], pa.float64()),
                    pa.array([place for _, _, place in found], pa.int64()),
                    pa.array([int(items.sizes[i]) for i, _, _ in found], pa.int64()),
                ],
                names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): items that documents hold, best window each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL"
    )
    # A text has at most half as many words as characters.
    size = items.agg(F.sum((F.char_length("text") + 1) / 2)).first()[0] or 0
    blocks = int(size // block_words) + 1
    schema = f"doc_id {kind}, item_id long, similarity double, first_word long, n_words long"
    found = []
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        block = Items([row["item_id"] for row in part], [row["text"] for row in part])
        found.append(mapped(rows, _search(block, least), schema))
    return reduce(DataFrame.unionByName, found)
