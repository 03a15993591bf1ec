"""Near-duplicate groups by SuperMinHash signatures.

Every element of a set (a five-word shingle) walks the slots of the signature in the
order of its own random permutation and offers the rank of the step plus a random
fraction; a slot keeps the least offer. The ranks of one element are correlated,
which lowers the variance, and the walk of a set stops once no later rank can
improve any slot. Signatures are cut into bands; documents that share a band
are candidates, and every link is confirmed on the full shingle sets.

Equal sets are one class from the start. All pairs of a bucket are never formed. First
every bucket's pivot, the set with the fewest shingles that no other candidate has, is
compared with the members, and links merge components (union-find by hooking and
pointer jumping). Buckets that then hold several components are resolved by an
exact index: linked sets share one of the rarest shingles of either, so each remaining
set is listed under its rarest ones, as many as the threshold asks for, with a bound on
what it can share from there on. Under each shingle, members that cannot reach the
threshold with any other one leave, pivots are compared with the members that
other components hold, and a pivot that has met everyone leaves. The number of
pivots per list grows by `PIVOT_GROWTH` until every list holds one component. So each pair of
candidates is in one component already, cannot be a link, or has been compared.

With 32 bands of 6 slots a pair at the threshold of 0.85 shares no band with a
probability of 3 in 10 million, and less above it; with 40 bands of 5 that is 1 in
10 million at 0.8.

Null texts, empty texts and texts without words have no shingles and stay alone.
Rows with equal ids and texts get equal results; a null id is not linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import mapped, stored, text_blocks
from wardlight.llm.words import mixed, odd_constants, shingle_sets

BANDS = 32
BAND_SLOTS = 6
SHINGLE = 5
THRESHOLD_PERCENT = 85
#: Factor by which the pivots per list grow from round to round.
PIVOT_GROWTH = 8


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """The signatures of the sets, a row each: rank in the high, fraction in the low 32 bits."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    signatures = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = signatures.reshape(-1)
    order = None  # the permutations of the elements still walking, as far as shuffled
    for rank in range(slots):
        draw = mixed(elements + odd_constants(1, 1000 + rank))
        swap = rank + ((draw >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = swap
        else:
            rows = np.arange(len(order))
            slot = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, rank]
            order[:, rank] = slot
        offer = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(rank << 32)
        np.minimum.at(flat, owner * slots + slot, offer)
        # A set is done when all its slots hold a rank no later offer can beat.
        walking = signatures.max(axis=1) >= np.uint64((rank + 1) << 32)
        left = walking[owner]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (int(left.sum()), 1))
            rows = np.arange(len(order))
            order[rows, swap[left]] = 0
            order[:, 0] = swap[left]
        elif not left.all():
            order = order[left]
        if not left.all():
            elements, owner = elements[left], owner[left]
        if not len(elements):
            break
    return signatures


def band_hashes(signatures: np.ndarray, bands: int, band_slots: int) -> np.ndarray:
    """One hash per band; equal hashes mean equal slots of the same band."""
    found = np.empty((len(signatures), bands), np.uint64)
    factors = odd_constants(band_slots, 77)
    for band in range(bands):
        part = signatures[:, band * band_slots : (band + 1) * band_slots]
        found[:, band] = mixed((part * factors).sum(axis=1, dtype=np.uint64) + np.uint64(band + 1))
    return found


def _sign(n_bands: int, band_slots: int):
    """Set size, set digest and band hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for start, end in text_blocks(texts):
                sets = shingle_sets(texts[start:end], SHINGLE)
                bands = band_hashes(superminhash(sets, n_bands * band_slots), n_bands, band_slots)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, bands.size + 1, n_bands), pa.int32()),
                            pa.array(bands.reshape(-1).view(np.int64)),
                        ),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets themselves."""
    for batch in batches:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        for start, end in text_blocks(texts):
            sets = shingle_sets(texts[start:end], SHINGLE)
            offsets = np.cumsum([0, *(len(s) for s in sets)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, end - start),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64))
                    ),
                ],
                names=["doc_id", "shingles"],
            )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with these edges (a, b): the least node reachable.

    Each round hooks every node to the least label around it and then follows
    labels one jump, until nothing changes.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "component-edges",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("component")
        ),
        "component-labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near")
        )
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stored(
            hooked.join(jump, "component", "left").select(
                "node", F.least("component", "next").alias("component"), "old"
            ),
            "component-labels",
        )
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, by exact intersection."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * common >= percent * (F.size("left") + F.size("right") - common))
        .select("a", "b")
    )


def groups(
    docs: DataFrame, percent: int = THRESHOLD_PERCENT, bands: int = BANDS, band_slots: int = BAND_SLOTS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(
        mapped(
            rows, _sign(bands, band_slots), f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>"
        ),
        "minhash-bands",
    )
    classes = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "minhash-classes",
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = stored(banded.join(shared, "key"), "minhash-members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(
        mapped(
            rows.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), _sets, f"doc_id {kind}, shingles array<long>"
        ),
        "minhash-sets",
    )
    own = (
        sets.select("doc_id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("doc_id").alias("rep"))
        .where("holders = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("own"))
    )
    members = stored(
        members.join(own, "rep", "left").select("key", "rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c")),
        "minhash-members",
    )
    labels = _merged(members, sets, percent)
    by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("class_component")
    )
    return signed.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_component"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )


def _reach(n: Column, c: Column, other_n: Column, other_c: Column, percent: int) -> Column:
    """Whether sets of n and other_n shingles, c and other_c of them shared with anyone, can be linked."""
    most = F.least(c, other_c)
    return 100 * most >= percent * F.greatest(n + other_n - most, n, other_n)


def _compared(
    members: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame, percent: int, rounds: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, labels and open members after comparing pivots with the members of every list.

    members: (key, rep, n shingles, c of which can be shared under this key). Runs until
    every list is resolved, or for so many rounds.
    """
    pivots_per_key, tested = 1, links.limit(0)
    while True:
        labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "n", "c", F.coalesce("component", "rep").alias("component")
        )
        keys = labelled.groupBy("key").agg(
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.min("n").alias("least_n"),
            F.max("c").alias("most_c"),
        )
        reaches = _reach(F.col("n"), F.col("c"), F.col("least_n"), F.col("most_c"), percent)
        alive = stored(
            labelled.join(keys.where("least < most"), "key")
            .where(reaches)
            .select("key", "rep", "n", "c", "component"),
            "minhash-alive",
        )
        if rounds == 0 or alive.isEmpty():
            return links, labels, alive
        rounds = None if rounds is None else rounds - 1
        # Lists agree on the first pivot, the set that can share most; later ones are drawn.
        share = F.pmod(F.xxhash64("rep"), F.lit(pivots_per_key))
        first = (F.col("n") - F.col("c")) if pivots_per_key == 1 else F.xxhash64("rep", F.lit(pivots_per_key))
        pivots = stored(
            alive.groupBy("key", share.alias("share"))
            .agg(F.min(F.struct(first.alias("first"), "rep", "n", "c", "component")).alias("pivot"))
            .select(
                "key",
                F.col("pivot.rep").alias("a"),
                F.col("pivot.n").alias("a_n"),
                F.col("pivot.c").alias("a_c"),
                F.col("pivot.component").alias("a_component"),
            ),
            "minhash-pivots",
        )
        reaches = _reach(F.col("n"), F.col("c"), F.col("a_n"), F.col("a_c"), percent)
        apart = F.col("component") != F.col("a_component")
        pairs = stored(
            alive.join(pivots, (alive["key"] == pivots["key"]) & apart & reaches)
            .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
            .distinct()
            .join(tested, ["a", "b"], "left_anti"),
            "minhash-pairs",
        )
        found = stored(confirmed(pairs, sets, percent), "minhash-links")
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        members = alive.select("key", "rep", "n", "c").join(
            pivots.select("key", F.col("a").alias("rep")), ["key", "rep"], "left_anti"
        )
        pivots_per_key *= PIVOT_GROWTH


def _rare_lists(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets under their rarest shingles: (key, rep, n, c), c counting from that shingle on.

    Two linked sets of n and m shingles share at least percent * n / 100 of the first,
    so one of the first n - that + 1 in any common order is shared; the first
    shared one bounds what they share by the shingles from it on.
    """
    shingles = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key")
    )
    frequency = shingles.groupBy("key").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("rep").orderBy("holders", "key")
    listed = shingles.join(frequency, "key").withColumn("before", F.row_number().over(order).cast("long") - 1)
    return listed.where(
        (F.col("before") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100)) & (F.col("holders") > 1)
    ).select("key", "rep", "n", (F.col("n") - F.col("before")).alias("c"))


def _merged(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the buckets' members (key, rep, n, c)."""
    links = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    links, labels, left = _compared(members, sets, links, labels, percent, rounds=1)
    reps = stored(left.select("rep").distinct(), "minhash-left")
    if reps.isEmpty():
        return labels
    lists = stored(_rare_lists(reps, sets, percent), "minhash-lists")
    return _compared(lists, sets, links, labels, percent)[1]
