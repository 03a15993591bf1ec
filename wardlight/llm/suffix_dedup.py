"""Removal of byte strings that occur earlier, by a hash-compared suffix sort.

Suffixes are compared by prefix polynomial hashes: a binary search over hashes of
growing prefixes finds the common extension of two suffixes in a logarithmic
number of steps, and the byte behind it decides. A bottom-up mergesort of these
comparisons orders the suffixes; neighbours' common extensions are then
verified byte by byte, and a collision starts the sort anew with another base.

Not every byte needs a suffix. Each `length`-byte window chooses the 24-byte string
with the least hash in it (its anchor), so equal windows choose the same one. Spark counts
the anchors of all texts; windows of an anchor that occurs once are unique.
The context of an anchor is everything a window that chose it can reach. Equal contexts
form a class, found in an aggregate by the anchor and a 128-bit digest of the context's bytes (BLAKE2, so that
no texts of unequal contexts can be made to meet): all but its first member are repeats entirely. The first members of an anchor's classes differ near an edge, and only they
are sorted, forwards and backwards from the anchor, in bounded buckets; the
common extensions to both sides give the windows they share. An anchor with more classes than
`GROUP_LIMIT` is not grouped in one task: its windows are counted by Spark, one row each.

Texts with equal bytes form a class before all this. "Earlier" is by doc_id, then by
place. Null texts are empty, and nothing is removed from rows with a null doc_id.
Rows that repeat an id with another text are documents of their own, in the order of their
texts' digests; rows that repeat the text too get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import by_text, hashed, in_several, released, stored, text_blocks
from wardlight.llm.words import mixed, odd_constants, power_tables

LENGTH = 100
ANCHOR = 24
#: Contexts of one anchor that are sorted together, at most.
GROUP_LIMIT = 20_000
#: Contexts that are sorted together, about.
BUCKET = 10_000
#: Bytes that are looked at together, about.
BLOCK_BYTES = 1 << 18
#: A context's reach to the left counts this much more than one to the right.
REACH = 1 << 14


def _sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """reduce over every `width` consecutive values, by doubling."""
    done, span = values, 1
    while span * 2 <= width:
        done = reduce(done[:-span], done[span:])
        span *= 2
    if span < width:
        done = reduce(done[: len(done) - (width - span)], done[width - span :])
    return done


def _prefix_sums(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of the bytes, and the factors that undo their place."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64) + np.uint64(1)
    if seed:
        values = mixed(values + np.uint64(seed))
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def anchors(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in the joined bytes, their hashes, and where each text starts and ends."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(bodies), np.uint8)
    grams = len(data) - ANCHOR + 1
    windows = len(data) - length + 1
    if windows <= 0 or not (sizes >= length).any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), starts, ends
    sums, down = _prefix_sums(data)
    hashes = mixed((sums[ANCHOR:] - sums[:grams]) * down[:grams])
    left = np.repeat(ends, sizes)  # where each byte's text ends
    width = length - ANCHOR + 1
    least = _sliding(hashes, width, np.minimum)
    inside = left[:windows] - np.arange(windows) >= length
    # An anchor equals the least hash of some window over it: look at the largest of those.
    bound = np.zeros(windows + 2 * (width - 1), np.uint64)
    bound[width - 1 : width - 1 + windows] = np.where(inside, least, 0)
    chosen = hashes == _sliding(bound, width, np.maximum)
    places = np.flatnonzero(chosen)
    return places, hashes[places], starts, ends


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [body or b"" for body in batch.column("body").to_pylist()]


def _sign(length: int):
    """Size, digest and anchors of each text; an anchor it holds again is listed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _bodies(batch)
            for start, end in text_blocks(bodies, BLOCK_BYTES):
                own = bodies[start:end]
                places, keys, _, ends = anchors(own, length)
                cuts = np.searchsorted(places, ends)
                lists = []
                for part in np.split(keys, cuts[:-1]):
                    distinct, times = np.unique(part, return_counts=True)
                    lists.append(np.concatenate([distinct, distinct[times > 1]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([len(b) for b in own], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in own], pa.string()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()),
                            pa.array(np.concatenate(lists).view(np.int64)),
                        ),
                    ],
                    names=["doc_id", "n_bytes", "text_sha256", "keys"],
                )

    return run


def _contexts(length: int):
    """The context of every shared anchor: its digest, the anchor's place, and its reach to both sides."""
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, shared = _bodies(batch), batch.column("keys")
            for start, end in text_blocks(bodies, BLOCK_BYTES):
                own = bodies[start:end]
                places, keys, starts, ends = anchors(own, length)
                wanted = shared.slice(start, end - start).flatten().to_numpy().view(np.uint64)
                hit = np.isin(keys, wanted)
                places, keys = places[hit], keys[hit]
                text = np.searchsorted(ends, places, side="right")
                before = np.minimum(places - starts[text], reach)
                after = np.minimum(ends[text] - places, length)
                data = b"".join(own)
                digests = b"".join(
                    hashlib.blake2b(data[a:b], digest_size=16).digest()
                    for a, b in zip((places - before).tolist(), (places + after).tolist(), strict=True)
                )
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start).take(pa.array(text)),
                        pa.array(keys.view(np.int64)),
                        pa.array(halves[:, 0].copy()),
                        pa.array(halves[:, 1].copy()),
                        pa.array(places - starts[text]),
                        pa.array((before * REACH + after).astype(np.int32)),
                    ],
                    names=["doc_id", "key", "context", "check", "place", "reach"],
                )

    return run


def _cut_out(length: int):
    """The bytes of the contexts listed for each text."""
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, listed = _bodies(batch), batch.column("found")
            owner, keys, places, before, context = [], [], [], [], []
            for number, body in enumerate(bodies):
                for entry in listed[number].as_py():
                    place = entry["place"]
                    first = max(place - reach, 0)
                    owner.append(number)
                    keys.append(entry["key"])
                    places.append(place)
                    before.append(place - first)
                    context.append(body[first : place + length])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(keys, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(before, pa.int32()),
                    pa.array(context, pa.binary()),
                ],
                names=["doc_id", "key", "place", "before", "context"],
            )

    return run


class SuffixOrder:
    """Strings of a matrix's rows, sorted within groups by comparing prefix hashes.

    `symbols` holds bytes plus one, 0 behind a string's end; `groups` ascends.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, groups: np.ndarray, seed: int = 0):
        self.symbols, self.lengths, self.groups = symbols, lengths, groups
        while True:
            factors = odd_constants(symbols.shape[1], 500 + seed)
            self.prefixes = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
            np.cumsum(mixed(symbols + np.uint64(seed)) * factors, axis=1, out=self.prefixes[:, 1:])
            self.order = self._sorted()
            self.common = self.extension(self.order[:-1], self.order[1:])
            if self._verified():
                return
            seed += 1

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.lengths[a], self.lengths[b])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.prefixes[a, middle] == self.prefixes[b, middle]
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def _before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row a sorts before row b; `ties` is the answer for equal strings."""
        at = self.extension(a, b)
        edge = self.symbols.shape[1] - 1
        next_a = np.where(at < self.lengths[a], self.symbols[a, np.minimum(at, edge)], 0)
        next_b = np.where(at < self.lengths[b], self.symbols[b, np.minimum(at, edge)], 0)
        return (next_a < next_b) | (ties & (next_a == next_b))

    def _sorted(self) -> np.ndarray:
        """Mergesort: runs of each group double until one run is left."""
        count = len(self.groups)
        order = np.arange(count)
        if not count:
            return order
        heads = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]])
        sizes = np.diff(heads, append=count)
        head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max():
            slots = np.flatnonzero(size > width)
            within = slots - head[slots]
            run = within // width
            own_start = head[slots] + run * width
            other_start = head[slots] + (run ^ 1) * width
            end = head[slots] + size[slots]
            low = np.minimum(other_start, end)
            high = np.minimum(other_start + width, end)
            first = low.copy()
            rows, on_left = order[slots], run % 2 == 0
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) >> 1
                # Partners that sort before: strictly for the left run, ties too for the right one.
                less = self._before(order[middle], rows[todo], ties=~on_left[todo])
                low[todo] = np.where(less, middle + 1, low[todo])
                high[todo] = np.where(less, high[todo], middle)
            merged = order.copy()
            merged[np.minimum(own_start, other_start) + (slots - own_start) + (low - first)] = rows
            order, width = merged, width * 2
        return order

    def _verified(self) -> bool:
        """Whether the neighbours' common extensions hold byte by byte."""
        a, b = self.order[:-1], self.order[1:]
        inside = np.arange(self.symbols.shape[1]) < self.common[:, None]
        return not (inside & (self.symbols[a] != self.symbols[b])).any()

    def classes(self, least: int) -> np.ndarray:
        """For each row the number of its class of equal prefixes of `least` symbols."""
        new = np.ones(len(self.order), bool)
        same_group = self.groups[self.order[1:]] == self.groups[self.order[:-1]]
        new[1:] = ~(same_group & (self.common >= least))
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.cumsum(new)
        return found


def _shared_windows(length: int):
    """Repeated spans of a bucket of contexts, by sorting them away from their anchors."""
    reach = length - ANCHOR

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        docs, places = table.column("doc_id").to_numpy(), table.column("place").to_numpy()
        arranged = np.lexsort((places, docs, keys))
        # Rows that repeat a document list its contexts again.
        own = np.column_stack([keys, docs, places])[arranged]
        arranged = arranged[np.r_[True, (own[1:] != own[:-1]).any(axis=1)][: len(own)]]
        keys, docs, places = keys[arranged], docs[arranged], places[arranged]
        before = table.column("before").to_numpy()[arranged].astype(np.int64)
        contexts = table.column("context").take(pa.array(arranged)).to_pylist()
        after = np.array([len(c) for c in contexts], np.int64) - before
        right = np.zeros((len(keys), length), np.uint64)
        left = np.zeros((len(keys), reach), np.uint64)
        for i, context in enumerate(contexts):
            own = np.frombuffer(context, np.uint8).astype(np.uint64) + np.uint64(1)
            right[i, : after[i]] = own[before[i] :]
            left[i, : before[i]] = own[: before[i]][::-1]
        forwards, backwards = SuffixOrder(right, after, keys), SuffixOrder(left, before, keys)
        most, least = np.full(len(keys), -1), np.full(len(keys), -1)
        for offset in range(reach + 1):
            has = np.flatnonzero((before >= offset) & (after >= length - offset))
            window = forwards.classes(length - offset)[has] * (len(keys) + 1) + backwards.classes(offset)[has]
            # Rows stand in order of document and place within a group: the first of a class stays.
            first = np.unique(window, return_index=True)[1]
            repeat = np.ones(len(has), bool)
            repeat[first] = False
            rows = has[repeat]
            most[rows] = offset
            least[rows] = np.where(least[rows] < 0, offset, least[rows])
        found = np.flatnonzero(most >= 0)
        return pa.table(
            {
                "doc_id": pa.array(docs[found]),
                "start": pa.array(places[found] - most[found]),
                "end": pa.array(places[found] - least[found] + length),
            }
        )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text outside its spans."""
    for batch in batches:
        removed, runs, kept = [], [], []
        spans = batch.column("spans")
        for number, body in enumerate(_bodies(batch)):
            own = spans[number].values
            depth = np.zeros(len(body) + 1, np.int64)
            np.add.at(depth, own.field("start").to_numpy(), 1)
            np.add.at(depth, own.field("end").to_numpy(), -1)
            gone = np.cumsum(depth)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_cut", "n_runs", "left_sha256", "left_bytes"],
        )


def repeated_spans(rows: DataFrame, kind: str, keys: DataFrame, length: int, group_limit: int) -> DataFrame:
    """Spans (doc_id, start, end) of rows (doc_id, body) that occur earlier; they may overlap."""
    shared = stored(in_several(keys), "suffix-shared")
    contexts = stored(
        rows.join(hashed(shared), "doc_id").mapInArrow(
            _contexts(length),
            f"doc_id {kind}, key long, context long, check long, place long, reach int",
        ),
        "suffix-contexts",
    )
    released(shared)
    classes = stored(
        contexts.groupBy("key", "context", "check").agg(
            F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")
        ),
        "suffix-classes",
    )
    whole = stored(
        contexts.join(hashed(classes.where("n > 1").drop("n")), ["key", "context", "check"])
        .where("struct(doc_id, place) <> first")
        .selectExpr("doc_id", f"place - reach DIV {REACH} AS start", f"place + reach % {REACH} AS end"),
        "suffix-whole",
    )
    released(contexts)
    sizes = classes.groupBy("key").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
    listed = (
        classes.select("key", "first.doc_id", "first.place")
        .join(hashed(sizes), "key")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("key", "place")).alias("found"))
    )
    cut_out = rows.join(hashed(listed), "doc_id").mapInArrow(
        _cut_out(length), f"doc_id {kind}, key long, place long, before int, context binary"
    )
    open_contexts = stored(cut_out, "suffix-open")
    frequent = sizes.where(F.col("n_classes") > group_limit).select("key")
    buckets = open_contexts.count() // BUCKET + 1
    sorted_spans = (
        open_contexts.join(frequent, "key", "left_anti")
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .applyInArrow(_shared_windows(length), f"doc_id {kind}, start long, end long")
    )
    windows = (
        open_contexts.join(frequent, "key", "left_semi")
        .select(
            "key",
            "doc_id",
            (F.col("place") - F.col("before")).alias("from"),
            "context",
            F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)).alias("at"),
        )
        .select(
            "key",
            "doc_id",
            (F.col("from") + F.col("at")).alias("start"),
            F.sha2(F.substring("context", F.col("at") + 1, F.lit(length)), 256).alias("window"),
        )
    )
    earliest = windows.groupBy("key", "window").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    counted_spans = (
        windows.join(earliest, ["key", "window"])
        .where("struct(doc_id, start) <> first")
        .selectExpr("doc_id", "start", f"start + {length} AS end")
    )
    return whole.unionByName(sorted_spans).unionByName(counted_spans)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, with_bytes: bool = True
) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes.

    `kept_bytes` is null where nothing was removed.
    """
    return by_text(docs, lambda rows: _remove_repeats(rows, length, group_limit, with_bytes))


def _remove_repeats(docs: DataFrame, length: int, group_limit: int, with_bytes: bool) -> DataFrame:
    """`remove_repeats` of rows whose ids differ from text to text."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(
        rows.mapInArrow(_sign(length), f"doc_id {kind}, n_bytes long, text_sha256 string, keys array<long>"),
        "suffix-anchors",
    )
    long_enough = signed.where(f"n_bytes >= {length} AND doc_id IS NOT NULL")
    owners = stored(long_enough.groupBy("text_sha256").agg(F.min("doc_id").alias("rep")), "suffix-owners")
    keys = (
        long_enough.select("doc_id", "keys")
        .join(owners.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", F.explode("keys").alias("key"))
    )
    spans = stored(
        repeated_spans(rows, kind, keys, length, group_limit)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans")),
        "suffix-spans",
    )
    cut = rows.join(hashed(spans), "doc_id").mapInArrow(
        _remove, f"doc_id {kind}, n_cut long, n_runs long, left_sha256 string, left_bytes binary"
    )
    if not with_bytes:
        cut = cut.drop("left_bytes")
    copy = F.col("rep").isNotNull() & (F.col("doc_id") != F.col("rep"))
    columns = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha256", "text_sha256")).alias("kept_sha256"),
    ]
    if with_bytes:
        columns.append(F.when(copy, F.lit(b"")).otherwise(F.col("left_bytes")).alias("kept_bytes"))
    return (
        signed.drop("keys")
        .join(owners, "text_sha256", "left")
        .join(cut.dropDuplicates(["doc_id"]), "doc_id", "left")
        .select(*columns)
    )
