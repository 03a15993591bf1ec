"""The deduplicating operators against plain versions."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardlight.llm import decontamination, minhash, recompression, suffix_dedup
from wardlight.llm.words import tokenise


def test_groups(make_docs, tangled):
    rows = minhash.groups(make_docs(tangled)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(tangled)


def test_a_chain_of_links_is_one_group(make_docs):
    words = [f"w{i}" for i in range(60)]
    texts = {d: " ".join(words[d * 2 : d * 2 + 40]) for d in range(8)}
    rows = minhash.groups(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(texts)
    assert {r.component_id for r in rows} == {0}


def test_links_between_members_that_miss_the_first_pivot(spark, make_docs):
    # One bucket for all: 0 is linked to nobody, 1 to 2 and 3 to 4, in rounds that draw other pivots.
    words = {1: [f"a{i}" for i in range(50)], 3: [f"b{i}" for i in range(50)]}
    texts = {0: " ".join(f"c{i}" for i in range(50))}
    for first, own in words.items():
        texts[first], texts[first + 1] = " ".join(own), " ".join([*own[:-1], "z"])
    docs = make_docs(texts)
    members = docs.select(F.lit(7).cast("long").alias("key"), F.col("doc_id").alias("rep"), F.lit(46).cast("long").alias("n"))
    members = members.withColumn("c", F.col("n"))
    sets = docs.mapInArrow(minhash._sets, "doc_id long, shingles array<long>")
    found = {r.node: r.component for r in minhash._merged(members, sets, 85).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)]
    found = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {
        **{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50, 70: 70
    }


def check_words(docs, texts, window):
    rows = recompression.remove_repeats(docs, window).collect()
    expected = brute.without_repeated_words(texts, window)
    assert len(rows) == len(texts)
    for r in rows:
        n, removed, kept = expected[r.doc_id]
        assert (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) == (r.doc_id, n, removed, brute.sha256(kept))
        assert r.kept_text == (kept if removed else None)


@pytest.mark.parametrize("window", [2, 5, 13, 50])
def test_repeated_words(make_docs, tangled, window):
    check_words(make_docs(tangled), tangled, window)


def test_rounds_leave_a_symbol():
    assert [recompression.rounds_for(n) for n in (1, 6, 7, 13, 18, 19, 50)] == [0, 0, 1, 1, 1, 2, 3]


@pytest.mark.parametrize("group_limit", [20_000, 1])
def test_repeated_bytes(make_docs, tangled, group_limit):
    rows = suffix_dedup.remove_repeats(make_docs(tangled), group_limit=group_limit).collect()
    expected = brute.without_repeated_bytes(tangled)
    assert len(rows) == len(tangled)
    for r in rows:
        n, removed, runs, kept = expected[r.doc_id]
        found = (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        assert found == (r.doc_id, n, removed, runs, brute.sha256(kept))
        assert (None if r.kept_bytes is None else bytes(r.kept_bytes)) == (kept if removed else None)


def test_suffix_order_survives_colliding_hashes(monkeypatch):
    import numpy as np

    # With a base that hashes everything alike the sort starts anew.
    true_factors = suffix_dedup.odd_constants
    monkeypatch.setattr(
        suffix_dedup, "odd_constants", lambda n, seed: np.zeros(n, np.uint64) if seed == 500 else true_factors(n, seed)
    )
    strings = [b"banana", b"bandana", b"ban", b"can", b"ban"]
    symbols = np.zeros((5, 8), np.uint64)
    for i, s in enumerate(strings):
        symbols[i, : len(s)] = np.frombuffer(s, np.uint8).astype(np.uint64) + 1
    order = suffix_dedup.SuffixOrder(symbols, np.array([len(s) for s in strings]), np.zeros(5, np.int64))
    assert [strings[i] for i in order.order] == sorted(strings)
    assert order.common.tolist() == [3, 3, 3, 0]


@pytest.mark.parametrize("operator", [minhash.groups, recompression.remove_repeats, suffix_dedup.remove_repeats])
def test_empty_table_and_repeated_rows(make_docs, operator):
    assert operator(make_docs({})).count() == 0
    twice = operator(make_docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)])).collect()
    assert len(twice) == 4


def _thue_morse():
    """Two words of 1024 bytes that any polynomial hash modulo 2^64 confuses."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_words_made_to_collide(spark, make_docs):
    a, b = _thue_morse()
    common = [f"w{i}" for i in range(12)]
    texts = {
        1: a,
        2: b,
        3: " ".join([a, *common]),
        4: " ".join([b, *common]),
        5: " ".join([*common[:6], a, *common[6:], "end"]),
        6: " ".join([*common[:6], b, *common[6:], "end"]),
    }
    rows = minhash.groups(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(texts)
    assert {r.doc_id for r in rows if r.component_id == r.doc_id} >= {1, 2}
    check_words(make_docs(texts), texts, 13)
    items = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    found = decontamination.leaks(make_docs(texts), items).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(brute.leaks(texts, {1: texts[5]}))


def test_hashes_of_words(tangled):
    """Equal for equal words wherever they stand, distinct otherwise, both of them."""
    known = {}
    for text in [*tangled.values(), "x" * 7, "x" * 8, "x" * 9, "xxxxxxxx\x00", "\x00", "\x00\x00", "é" * 4, "é" * 5]:
        own = tokenise([text or "", f"  pad {text or ''}\n"])
        for word, *hashes in zip(brute.words(text) * 2, [*own.hashes[: own.counts[0]], *own.hashes[own.counts[0] + 1 :]],
                                 [*own.others[: own.counts[0]], *own.others[own.counts[0] + 1 :]], strict=True):
            assert known.setdefault(word, hashes) == hashes
    for side in zip(*known.values(), strict=True):
        assert len(set(side)) == len(known) > 300


PASSAGE = [f"shared{i}" for i in range(30)]


def _repeated_ids(short):
    """Ids 1, 2, 2, 3, 3, null: the first two share a passage; the second text of 2 is short or long."""
    other = "alpha beta" if short else " ".join(f"own{i}" for i in range(60))
    return [
        (1, " ".join(["one", *PASSAGE, "two"])),
        (2, " ".join(["alpha", *PASSAGE, "beta"])),
        (2, other),
        (3, " ".join(["x", *PASSAGE])),
        (3, " ".join(["x", *PASSAGE])),
        (3, None),
        (None, " ".join(PASSAGE)),
    ]


@pytest.mark.parametrize("short", [True, False])
def test_texts_that_share_an_id_are_documents_of_their_own(make_docs, short):
    rows = _repeated_ids(short)
    removed = recompression.remove_repeats(make_docs(rows)).collect()
    left = [(r.doc_id or 0, r.n_words, r.n_removed, r.kept_text or "") for r in removed]
    long = len(rows[2][1].split())
    assert sorted(left) == sorted(
        [(0, 30, 0, ""), (1, 32, 0, ""), (2, 32, 30, "alpha beta"), (2, long, 0, ""), (3, 0, 0, "")]
        + [(3, 31, 30, "x")] * 2
    )
    spans = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    passage = len(" " + " ".join(PASSAGE))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in spans) == sorted(
        (d or 0, len((t or "").encode()), 0 if d in (None, 1) or t == rows[2][1] or not t else passage + (d == 2))
        for d, t in rows
    )
