"""Removal of passages that earlier documents hold, found by recompression.

A round replaces runs of equal symbols by a name for (symbol, length) and then every
pair of a left and a right symbol by a name for the pair. Left or right is one bit
of the symbol's own hash, and a name is the hash of what it stands for, so all
tasks give equal content equal names without a dictionary to ship.
A decision depends on the two symbols it joins only. Hence a passage is parsed
alike wherever it occurs, but for the symbols at its two ends: after the rounds
that `rounds_for` allows, a window still holds a symbol that every copy of the
window holds too.

Each window chooses one of its consistent symbols (the longest in bytes, then by
name). All windows that chose a symbol hold the margin beside it as well, so symbol and
margin are the key that Spark counts; a window whose key occurs in one document only is
unique. Windows that hold a square (x x with x up to the size of a symbol)
choose themselves instead, as runs would reach beyond them. The context of a chosen
symbol is everything its windows can reach. Equal contexts form a class, verified by two
hashes beside the key: documents after its least one lose the context. Only where
a key has several classes, the windows of the least documents' contexts are
compared one by one, by two independent 64-bit hashes.

Documents with equal words form a class first; all but the least lose every word
if they hold a window at all. Null texts have no words. Rows that repeat an id with another
text are documents of their own, in the order of their texts' digests; rows that repeat
the text too get the same result. Rows with a null id lose nothing and take nothing from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import by_text, hashed, in_several, mapped, released, stored, text_blocks
from wardlight.llm.words import Words, mixed, odd_constants, power_tables, tokenise, window_hashes

WINDOW = 13


def rounds_for(window: int) -> int:
    """The most rounds after which every window keeps a consistent symbol.

    Round i loses up to two symbols of 2^(i-1) words at each end, and a stretch of
    2 * 2^r - 1 words holds a whole symbol of up to 2^r.
    """
    rounds = 0
    while window - 2 * (2 ** (rounds + 2) - 2) >= 2 * 2 ** (rounds + 1) - 1:
        rounds += 1
    return rounds


def recompress(words: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the final symbols, and the first word and the number of words of each."""
    names = words.hashes
    text = words.text_of()
    first = np.arange(len(names))
    for number in range(rounds):
        run_factor, left_factor, right_factor = odd_constants(3, 300 + number)
        if not len(names):
            break
        starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])])
        lengths = np.diff(starts, append=len(names))
        names, text, first = names[starts], text[starts], first[starts]
        run = lengths > 1
        names = np.where(run, mixed(names * run_factor + lengths.astype(np.uint64)), names)
        left = (mixed(names + odd_constants(1, 400 + number)) & np.uint64(1)).astype(bool)
        joins = left[:-1] & ~left[1:] & (text[1:] == text[:-1]) & ~run[:-1] & ~run[1:]
        merged = names.copy()
        merged[:-1][joins] = mixed(names[:-1][joins] * left_factor + names[1:][joins] * right_factor)
        keep = np.r_[True, ~joins]
        names, text, first = merged[keep], text[keep], first[keep]
    return names, first, np.diff(first, append=len(words.hashes))


def _squares(words: Words, longest: int, window: int) -> np.ndarray:
    """True for the windows that hold x x with x of 1 to `longest` words."""
    count = len(words.hashes) - window + 1
    found = np.zeros(max(count, 0), bool)
    for size in range(1, longest + 1):
        if count <= 0 or 2 * size > window:
            break
        same = words.hashes[size:] == words.hashes[:-size]
        runs = np.cumsum(np.r_[0, same])
        square = runs[size:] - runs[:-size] == size  # x x starts here
        places = np.cumsum(np.r_[0, square])
        span = window - 2 * size + 1
        found |= places[span : span + count] - places[:count] > 0
    return found


def _spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to its end."""
    up, down = power_tables(len(hashes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up[: len(hashes)])]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _first_best(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place of the greatest rank from each low to below its high."""
    places = [np.arange(len(rank))]
    while 1 << len(places) <= (high - low).max(initial=1):
        half = places[-1]
        other = half[np.minimum(np.arange(len(rank)) + (1 << len(places) - 1), len(rank) - 1)]
        places.append(np.where(rank[other] > rank[half], other, half))
    found = np.zeros(len(low), np.int64)
    level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    for k, best in enumerate(places):
        own = np.flatnonzero(level == k)
        left, right = best[low[own]], best[high[own] - (1 << k)]
        found[own] = np.where(rank[right] > rank[left], right, left)
    return found


def choices(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the windows chose: keys, and the first word and the end of each context."""
    empty = np.empty(0, np.int64)
    firsts = np.concatenate(
        [np.arange(f, f + c - window + 1) for f, c in zip(words.firsts.tolist(), words.counts.tolist(), strict=True) if c >= window]
        or [empty]
    )
    if not len(firsts):
        return empty.astype(np.uint64), empty, empty
    rounds = rounds_for(window)
    names, first, size = recompress(words, rounds)
    margin = 2 ** (rounds + 1) - 2
    last = first + size
    bytes_long = np.minimum(words.ends[last - 1] - words.starts[first], 0x7FFF).astype(np.uint64)
    rank = (bytes_long << np.uint64(48)) | (names >> np.uint64(16))
    # Symbols that start before a word; each ends where the next one starts.
    before = np.zeros(len(words.hashes) + 2, np.int64)
    before[first + 1] = 1
    before[-1] = 1
    before = np.cumsum(before)
    low, high = before[firsts + margin], before[firsts + window - margin + 1] - 1
    direct = _squares(words, 2 ** max(rounds - 1, 0), window)[firsts] | (high <= low)
    best = _first_best(rank, low[~direct], high[~direct])
    # The best of later windows is never an earlier one.
    chosen, alone = best[np.r_[True, best[1:] != best[:-1]][: len(best)]], firsts[direct]
    text = words.text_of()[first[chosen]]
    start = np.maximum(last[chosen] - window + margin, words.firsts[text])
    end = np.minimum(first[chosen] - margin + window, (words.firsts + words.counts)[text])
    # All windows that chose a symbol hold the margin on both sides of it too.
    reach = (first[chosen] - margin, last[chosen] + margin)
    named = mixed(_spans(words.hashes, *reach) + names[chosen])
    whole = window_hashes(words.hashes, window, seed=31)[alone]
    keys = np.concatenate([named, whole])
    starts, ends = np.concatenate([start, alone]), np.concatenate([end, alone + window])
    order = np.argsort(starts, kind="stable")
    return keys[order], starts[order], ends[order]


def _sign(window: int):
    """Words, digest of the joined words, and chosen keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for start, end in text_blocks(texts):
                words = tokenise(texts[start:end])
                digests = [
                    hashlib.sha256(b" ".join(text.encode("utf-8", "replace").split())).hexdigest()
                    for text in texts[start:end]
                ]
                keys, starts, _ = choices(words, window)
                cuts = np.searchsorted(starts, words.firsts + words.counts)
                lists = [np.unique(part) for part in np.split(keys, cuts[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(words.counts, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()),
                            pa.array(np.concatenate(lists).view(np.int64)),
                        ),
                    ],
                    names=["doc_id", "n_words", "words_sha256", "keys"],
                )

    return run


def _contexts(window: int):
    """The contexts of each text's shared keys: two hashes, first word and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            shared = batch.column("keys")
            for begin, stop in text_blocks(texts):
                words = tokenise(texts[begin:stop])
                keys, starts, ends = choices(words, window)
                wanted = shared.slice(begin, stop - begin).flatten().to_numpy().view(np.uint64)
                hit = np.isin(keys, wanted)
                keys, starts, ends = keys[hit], starts[hit], ends[hit]
                text = np.searchsorted(words.firsts + words.counts, starts, side="right")
                hashes = [_spans(source, starts, ends) for source in (words.hashes, words.others)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, stop - begin).take(pa.array(text)),
                        pa.array(keys.view(np.int64)),
                        pa.array(hashes[0].view(np.int64)),
                        pa.array((hashes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array((starts - words.firsts[text]).astype(np.int32)),
                        pa.array((ends - words.firsts[text]).astype(np.int32)),
                    ],
                    names=["doc_id", "key", "high", "low", "start", "end"],
                )

    return run


def _windows(window: int):
    """The windows (two hashes, first word) of the contexts listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            listed = batch.column("spans")
            for begin, stop in text_blocks(texts):
                words = tokenise(texts[begin:stop])
                part = listed.slice(begin, stop - begin)
                spans, base = part.flatten(), np.repeat(words.firsts, pc.list_value_length(part).to_numpy())
                depth = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(depth, base + spans.field("start").to_numpy(), 1)
                np.add.at(depth, base + spans.field("end").to_numpy() - window + 1, -1)
                firsts = np.flatnonzero(np.cumsum(depth))
                text = np.searchsorted(words.firsts + words.counts, firsts, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, stop - begin).take(pa.array(text)),
                        pa.array(window_hashes(words.hashes, window, seed=31)[firsts].view(np.int64)),
                        pa.array(window_hashes(words.others, window, seed=32)[firsts].view(np.int64)),
                        pa.array((firsts - words.firsts[text]).astype(np.int32)),
                    ],
                    names=["doc_id", "high", "low", "start"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text outside its spans."""
    for batch in batches:
        removed, kept = [], []
        texts = [text or "" for text in batch.column("text").to_pylist()]
        spans = batch.column("spans")
        for number, text in enumerate(texts):
            words = text.encode("utf-8", "replace").split()
            depth = np.zeros(len(words) + 1, np.int64)
            own = spans[number].values
            np.add.at(depth, np.minimum(own.field("start").to_numpy(), len(words)), 1)
            np.add.at(depth, np.minimum(own.field("end").to_numpy(), len(words)), -1)
            stay = np.cumsum(depth)[:-1] == 0
            removed.append(int(len(words) - stay.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(removed, pa.int64()),
                pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            names=["doc_id", "n_cut", "left_text", "left_sha256"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_removed, kept_sha256 and kept_text.

    `kept_text` is null where nothing was removed; otherwise the words left, one
    space between. The hash always covers the kept words joined that way.
    """
    return by_text(docs, lambda rows: _remove_repeats(rows, window, with_text))


def _remove_repeats(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """`remove_repeats` of rows whose ids differ from text to text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = stored(
        mapped(rows, _sign(window), f"doc_id {kind}, n_words long, words_sha256 string, keys array<long>"),
        "recompression-keys",
    )
    long_enough = signed.where(f"n_words >= {window} AND doc_id IS NOT NULL")
    classes = long_enough.groupBy("words_sha256").agg(F.min("doc_id").alias("rep"))
    owners = stored(classes, "recompression-classes")
    keys = (
        long_enough.select("doc_id", "keys")
        .join(owners.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", F.explode("keys").alias("key"))
    )
    # A document lists a key once, so a key of several rows is one of several documents.
    shared = stored(in_several(keys), "recompression-shared")
    contexts = stored(
        mapped(
            rows.join(hashed(shared), "doc_id"),
            _contexts(window),
            f"doc_id {kind}, key long, high long, low int, start int, end int",
        ),
        "recompression-contexts",
    )
    released(shared)
    classes = stored(
        contexts.groupBy("key", "high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")),
        "recompression-contexts-least",
    )
    several = classes.groupBy("key").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
    wanted = classes.join(hashed(several), "key", "left").where("least < most OR n_classes IS NOT NULL")
    decided = stored(
        contexts.join(hashed(wanted), ["key", "high", "low"])
        .where("doc_id > least OR n_classes IS NOT NULL")
        .select("doc_id", "start", "end", (F.col("doc_id") > F.col("least")).alias("gone")),
        "recompression-decided",
    )
    released(contexts, classes)
    listed = decided.where("NOT gone").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    windows = stored(
        mapped(rows.join(hashed(listed), "doc_id"), _windows(window), f"doc_id {kind}, high long, low long, start int"),
        "recompression-windows",
    )
    earliest = (
        windows.groupBy("high", "low")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("high", "low", "least")
    )
    single = (
        windows.join(hashed(earliest), ["high", "low"])
        .where("doc_id > least")
        .select("doc_id", "start", (F.col("start") + window).alias("end"))
    )
    repeats = stored(
        decided.where("gone")
        .select("doc_id", "start", "end")
        .unionByName(single)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans")),
        "recompression-repeats",
    )
    released(decided, windows)
    cut = mapped(
        rows.join(hashed(repeats), "doc_id"), _cut, f"doc_id {kind}, n_cut long, left_text string, left_sha256 string"
    )
    if not with_text:
        cut = cut.drop("left_text")
    copy = F.col("rep").isNotNull() & (F.col("doc_id") != F.col("rep"))
    columns = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha256", "words_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("left_text")).alias("kept_text"))
    return (
        signed.drop("keys")
        .join(owners, "words_sha256", "left")
        .join(cut.dropDuplicates(["doc_id"]), "doc_id", "left")
        .select(*columns)
    )
