"""Packing of tokenized documents into sequences by linear grouping.

Sizes are at most the capacity, so the histogram of piece sizes is a bounded
summary of any corpus, and the whole plan is made from it:

1. Large sizes are sorted and cut into groups of equal cardinality; every size
   counts as the largest of its group.
2. A configuration says how many pieces of each group share a sequence. A linear
   program over configurations, with columns generated by a knapsack, gives
   how often to use each; the whole parts are used.
3. Actual sizes take the places of their group, largest first; what the whole parts
   leave over is placed by best fit with the small sizes, largest first.

Sequences that hold the same sizes are one row of the plan with a count, so the plan's
length depends on the capacity, not on the corpus. A segment of the plan says: pieces of
one size, ranked r to r + n, take the same offset in n consecutive sequences.
Ranks within a size are counted by shards of documents, and a piece finds its segment
by size and rank. No row passes through the driver.

Null and empty texts are their end token alone. Equal rows are packed as often as they
occur. Documents longer than the capacity are cut from the end, so that only the
first piece is shorter. Very long texts are tokenized whole, in a block of their own. An empty table packs into
nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import mapped, stored, text_blocks

CAPACITY = 1024
END_ID = 2
GROUPS = 64
#: Pieces above this share of the capacity are large; the share that needs the fewest sequences is used.
LARGE_SHARES = (1 / 4, 2 / 5, 1 / 2)
#: Documents per shard when ranks are counted, about.
SHARD_ROWS = 50_000

# Fixed value: how byte-level tokenizers of this family cut a text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_IDS = np.dtype("<u4")


def tokenizer_path() -> str:
    """The byte-level tokenizer that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file defines them.

    The vocabulary of a byte-level file runs several times faster as tiktoken ranks. They
    join any neighbours whose bytes make a token, the tokenizer only the token's own
    pair. Both give the same ids if ids follow the order of the merges, tokens are made of
    tokens with lower ids, and every token's bytes alone are merged to it: neighbours
    that make a token have then been merged to its pair, as no merge has crossed their
    outer ends. Files of another kind, and texts that hold an added token, go through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.added = [entry["content"] for entry in settings.get("added_tokens") or []]
        self.fast = self._ranked(settings)

    def _ranked(self, settings: dict):
        """The file's vocabulary as tiktoken ranks, or None where they may give other ids."""
        splitter, model = settings.get("pre_tokenizer") or {}, settings["model"]
        byte_level = (
            splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and not any(settings.get(name) for name in ("normalizer", "truncation", "padding"))
            and model.get("type") == "BPE"
            and not any(
                model.get(name)
                for name in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
            )
        )
        if not byte_level:
            return None
        vocabulary, byte_of = model["vocab"], _byte_of_character()
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        made = ["".join(pair) for pair in pairs]
        numbers = [vocabulary[token] for token in made]
        agree = (
            all(character in vocabulary for character in byte_of)
            and set("".join(made)) <= byte_of.keys()
            and all(a < b for a, b in zip(numbers, numbers[1:]))
            and all(max(map(vocabulary.get, pair)) < number for pair, number in zip(pairs, numbers, strict=True))
            and all(len(self.tokenizer.model.tokenize(token)) == 1 for token in made)
        )
        if not agree:
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in token): vocabulary[token] for token in (*byte_of, *made)}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _defined(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(entry.ids, _IDS).tobytes() for entry in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._defined(texts)
        found = [np.array(self.fast.encode_to_numpy(text, disallowed_special=()), _IDS).tobytes() for text in texts]
        holding = [i for i, text in enumerate(texts) if any(content in text for content in self.added)]
        for i, ids in zip(holding, self._defined([texts[i] for i in holding]), strict=True):
            found[i] = ids
        return found


def _encoder(path: str) -> Encoder:
    """The worker process's encoder; it hangs on an imported module, as task functions come anew."""
    import tokenizers

    held = vars(tokenizers).setdefault("_remembered_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    first = length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def _tokenize(path: str, capacity: int, end_id: int, with_ids: bool):
    """Rows (doc_id, piece, start, length, ids_crc32[, ids])."""
    end_bytes = np.array([end_id], _IDS).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for first, last in text_blocks(texts):
                owner, piece, start, size, crc, ids = [], [], [], [], [], []
                for number, packed in enumerate(encoder.encode(texts[first:last])):
                    packed += end_bytes
                    for k, (at, length) in enumerate(cut_points(len(packed) // 4, capacity)):
                        own = packed[4 * at : 4 * (at + length)]
                        owner.append(number)
                        piece.append(k)
                        start.append(at)
                        size.append(length)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, _IDS).astype(np.int32))
                columns = [
                    batch.column("doc_id").slice(first, last - first).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, ids)])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def grouped(sizes: list[int], counts: list[int], groups: int) -> list[list[tuple[int, int]]]:
    """Sizes, largest first, cut into groups of equal cardinality as (size, count) runs."""
    total = sum(counts)
    each = max(1, -(-total // groups))
    found: list[list[tuple[int, int]]] = []
    room = 0
    for size, count in zip(sizes, counts, strict=True):
        while count:
            if not room:
                found.append([])
                room = each
            taken = min(room, count)
            found[-1].append((size, taken))
            room -= taken
            count -= taken
    return found


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        if fits.any():
            offer = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
            item = int(offer.argmax())
            best[room] = offer[item]
            pick[room] = item
            if best[room - 1] >= best[room]:
                best[room], pick[room] = best[room - 1], -1
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            column[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses that do not exceed the demand.

    The linear program's revised simplex starts from one configuration per size; each
    step lets the knapsack's best configuration enter.
    """
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    uses = inverse @ demand
    for _ in range(steps):
        prices = inverse.sum(axis=0)
        value, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, uses / direction, np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        step = max(ratio[leaving], 0.0)
        uses = uses - step * direction
        uses[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse = inverse - np.outer(direction, row)
        inverse[leaving] = row
        columns[:, leaving] = column
    found, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-uses):
        column = columns[:, j].astype(np.int64)
        held = column > 0
        times = min(int(np.floor(uses[j] + 1e-6)), int((left[held] // column[held]).min())) if held.any() else 0
        if times > 0:
            left -= times * column
            found.append((column, times))
    return found


class _Plan:
    """Kinds of sequences by room left, and the segments that fill them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.ranked: dict[int, int] = {}
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
        self.rooms: list[int] = []

    def place(self, size: int, first: int, count: int, room: int) -> None:
        rank = self.ranked.get(size, 0)
        self.ranked[size] = rank + count
        self.segments.append((size, rank, count, first, self.capacity - room))

    def keep(self, room: int, first: int, count: int) -> None:
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((first, count))

    def take(self, room: int) -> tuple[int, int]:
        found = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            self.rooms.remove(room)
        return found

    def fill(self, column: np.ndarray, times: int, stock: list[list[tuple[int, int]]]) -> None:
        """`times` sequences of a configuration with actual sizes of its groups."""
        kinds = [(self.sequences, times, self.capacity)]
        self.sequences += times
        for group in np.repeat(np.arange(len(column)), column).tolist():
            split = []
            for first, count, room in kinds:
                while count:
                    size, have = stock[group].pop()
                    taken = min(have, count)
                    if have > taken:
                        stock[group].append((size, have - taken))
                    self.place(size, first, taken, room)
                    split.append((first, taken, room - size))
                    first += taken
                    count -= taken
            kinds = split
        for first, count, room in kinds:
            if room:
                self.keep(room, first, count)

    def best_fit(self, size: int, count: int) -> None:
        """Pieces of one size where they leave the least room, or in new sequences."""
        while count:
            at = bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, have = self.take(room)
            else:
                room, first, have = self.capacity, self.sequences, -(-count // (self.capacity // size))
                self.sequences += have
            taken = min(have, count)
            if have > taken:
                self.keep(room, first + taken, have - taken)
            self.place(size, first, taken, room)
            if room > size:
                self.keep(room - size, first, taken)
            count -= taken


def plan(
    histogram: dict[int, int], capacity: int, groups: int = GROUPS, large_shares: tuple[float, ...] = LARGE_SHARES
) -> list[tuple[int, int, int, int, int]]:
    """Segments (size, first rank, count, first sequence, offset) that place every piece."""
    plans = [_plan(histogram, capacity, groups, share) for share in large_shares]
    return min(plans, key=lambda found: found.sequences).segments


def _plan(histogram: dict[int, int], capacity: int, groups: int, large_share: float) -> _Plan:
    result = _Plan(capacity)
    large = sorted((s for s in histogram if s > capacity * large_share), reverse=True)
    stock = grouped(large, [histogram[s] for s in large], groups)
    for group in stock:
        group.reverse()  # pop takes the largest first
    if stock:
        sizes = np.array([max(size for size, _ in group) for group in stock])
        demand = np.array([sum(count for _, count in group) for group in stock], float)
        for column, times in configurations(sizes, demand, capacity):
            result.fill(column, times, stock)
    rest = {s: n for s, n in histogram.items() if s <= capacity * large_share}
    for group in stock:
        for size, count in group:
            rest[size] = rest.get(size, 0) + count
    for size in sorted(rest, reverse=True):
        result.best_fit(size, rest[size])
    return result


def _assign(segments: list[tuple[int, int, int, int, int]]):
    """Gives each (row, length, rank) its sequence and offset."""
    rows = np.array(sorted(segments), np.int64).reshape(-1, 5)
    size, rank, _, first, offset = rows.T
    heads = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            at = np.empty(len(lengths), np.int64)
            own_sizes = size[heads]
            for length in np.unique(lengths):
                low = heads[np.searchsorted(own_sizes, length)]
                high = np.searchsorted(size, length, side="right")
                mine = lengths == length
                at[mine] = low + np.searchsorted(rank[low:high], ranks[mine], side="right") - 1
            kept = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(first[at] + ranks - rank[at]), pa.array(offset[at])],
                names=[*kept, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    groups: int = GROUPS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = mapped(
        rows,
        _tokenize(path or tokenizer_path(), capacity, end_id, with_ids),
        columns + (", ids array<int>" if with_ids else ""),
    )
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    shards = pieces.count() // SHARD_ROWS + 1
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    placed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "row", shard)
    counts = placed.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy("row"))
    ranked = (
        placed.withColumn("local", local)
        .join(offsets, ["length", "shard"])
        .select(*placed.columns[:-1], (F.col("skipped") + F.col("local") - 1).alias("rank"))
    )
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = mapped(
        ranked, _assign(plan(histogram, capacity, groups)), columns + ", row long, sequence_id long, offset long"
    )
    if with_ids:
        found = found.join(pieces.select("row", "ids"), "row")
    return found.drop("row")
