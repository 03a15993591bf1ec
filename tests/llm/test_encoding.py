"""Piece encoding, infilling and the Merkle manifest on small frames."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import brute
from wardlight.llm import infilling, merkle, piece_encoding
from wardlight.llm.queries import llm_queries

WIDE = random.Random(7)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())


@pytest.fixture(scope="module")
def encoder():
    return piece_encoding.Encoder.load(piece_encoding.model_path())


def _assert_same(library, encoder, texts):
    ids, sizes = encoder.encode(texts)
    at = 0
    for text, size, expected in zip(texts, sizes.tolist(), library.encode(texts), strict=True):
        assert ids[at : at + size].tolist() == expected, text[:100]
        assert encoder.decode(expected) == library.decode(expected)
        at += size


def test_encodes_texts_of_every_kind(library, encoder):
    letters = [chr(c) for c in range(97, 123)]
    texts = ["", " ", "   ", "\n", "▁", "a▁▁b   c", "Hello <s> </s> <0x0A>\tzß漢字 \x00 🙂  ", "x" * 5000, "ab" * 400]
    texts += ["".join(WIDE.choice(letters) for _ in range(n)) for n in (1, 7, 300, 20_000)]
    texts += ["".join(WIDE.choice("ab c.\n1é漢🙂<>▁") for _ in range(200)) for _ in range(200)]
    _assert_same(library, encoder, texts)


def test_encodes_pieces_in_a_row(library, encoder):
    """Texts of pieces bring up joins of a better rank beside new symbols."""
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    for strip in (False, True):
        texts = [
            "".join(p.strip() if strip else p for p in WIDE.choices(pieces, k=WIDE.randint(1, 80))) for _ in range(1500)
        ]
        _assert_same(library, encoder, texts)


def test_remembered_words_change_nothing(library, monkeypatch):
    own = piece_encoding.Encoder.load(piece_encoding.model_path())
    monkeypatch.setattr(piece_encoding, "_KNOWN_WORDS", 20)
    for k in range(8):
        _assert_same(library, own, [f"some words number{k} and {WIDE.random()} more " * 3 for _ in range(5)])


def test_decodes_any_ids(library, encoder):
    for _ in range(500):
        ids = [WIDE.randrange(32_000 if WIDE.random() < 0.6 else 259) for _ in range(WIDE.randint(0, 40))]
        assert encoder.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError, match="outside the vocabulary"):
        encoder.decode([32_000])


def test_refuses_models_it_would_encode_otherwise():
    unigram = bytes([18, 4, 24, 1, 152, 2]) + b"\x01"  # trainer: model type 1
    with pytest.raises((ValueError, KeyError, IndexError)):
        piece_encoding._require_supported(unigram)
    normalising = bytes([18, 5, 24, 2, 152, 2, 1]) + bytes([26, 3, 18, 1, 65])
    with pytest.raises(ValueError, match="no character map"):
        piece_encoding._require_supported(normalising)


def test_encodes_rows(spark, make_docs, tangled, library):
    docs = make_docs([*tangled.items(), (7, tangled[7]), (None, "no id")]).withColumns(
        {"ids": F.lit(1), "decoded": F.lit("own")}
    )
    rows = piece_encoding.decode(piece_encoding.encode(docs).withColumn("offsets", F.lit(0))).collect()
    assert len(rows) == len(tangled) + 2
    for row in rows:
        text = "no id" if row.doc_id is None else tangled[row.doc_id] or ""
        assert row.ids == library.encode(text) and row.decoded == library.decode(row.ids)
    assert piece_encoding.decode(piece_encoding.encode(docs.limit(0))).count() == 0


def test_piece_query_against_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = llm_queries()["op11_piece_encoding"](spark, small).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == brute.sha256(",".join(map(str, ids)))
        assert row.decoded_sha256 == brute.sha256(library.decode(ids))


def _plain_infilling(doc_id, text):
    """By one unit after the other, without the regular expression."""
    units, unit, seen = [], "", False
    for c in text:
        space = c == " " or "\t" <= c <= "\r"
        if space and seen:
            units.append(unit)
            unit, seen = "", False
        unit += c
        seen = seen or not space
    units += [unit] if unit else []
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h[2] % 100 >= 50 or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_against_plain(spark, make_docs, tangled):
    texts = dict(tangled)
    texts |= {d: " ".join(f"{WIDE.random()}\n"[:9] for _ in range(WIDE.randint(0, 30))) for d in range(100, 400)}
    texts |= {400 + i: t for i, t in enumerate(["<P>a", "a <S>", "<M>", "<", "<S", "ends <S ", "é  ", "\x0b\x0c", "🙂 x"] * 4)}
    texts[500] = "word " * 200_000
    docs = make_docs(texts).withColumns({"output": F.lit("own"), "form": F.lit(3)})
    rows = infilling.restore(infilling.transform(docs)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        found = (row.n, row.form, row.prefix_chars, row.middle_chars, row.output)
        assert found == _plain_infilling(row.doc_id, text)
        assert row.restored == text
    assert {row.form for row in rows} == {"plain", "psm", "spm"}


def test_infilling_of_odd_rows(spark, make_docs):
    docs = make_docs([(1, "a b c"), (1, "a b c"), (None, "some text"), (2, None), (3, "")])
    rows = infilling.restore(infilling.transform(docs, rewritten_percent=100)).collect()
    assert sorted((r.doc_id or 0, r.restored) for r in rows) == [
        (0, "some text"), (1, "a b c"), (1, "a b c"), (2, ""), (3, ""),
    ]
    assert {r.form for r in rows if r.doc_id in (2, 3)} == {"plain"}
    assert infilling.restore(infilling.transform(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="starts with"):
        infilling.rebuild("text", "psm")


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def _plain_siblings(levels, at, fanout):
    found = []
    for level in levels[:-1]:
        start = at - at % fanout
        found += level[start:at] + level[at + 1 : start + fanout]
        at //= fanout
    return found


def _plain_manifest(rows, fanout):
    """[(doc_id, source, leaf, subroot, root, siblings)] of (doc_id, source, text) rows."""

    def written(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    sources = {}
    for doc_id, source, text in rows:
        size = None if text is None else len(text)
        leaf = _digest(*map(written, (doc_id, source, "en", size, text)))
        sources.setdefault(source, []).append((doc_id is not None, doc_id, leaf))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _plain_levels([leaf for *_, leaf in sorted(sources[s])], fanout) for s in names}
    top = _plain_levels([trees[s][-1][0] for s in names], fanout)
    return sorted(
        (str(doc_id), str(s), leaf, trees[s][-1][0], top[-1][0],
         _digest(*_plain_siblings(trees[s], i, fanout), *_plain_siblings(top, k, fanout)))
        for k, s in enumerate(names)
        for i, (_, doc_id, leaf) in enumerate(sorted(sources[s]))
    )


def _source(make_docs, rows):
    texts = make_docs([(i, None) for i in range(len(rows))])
    schema = texts.schema
    return texts.sparkSession.createDataFrame(
        [(d, t, "en", s, None if t is None else len(t)) for d, s, t in rows], schema
    )


@pytest.mark.parametrize("fanout, kept_every", [(16, 2), (2, 1), (2, 3), (3, 2)])
def test_manifest_against_plain(spark, make_docs, fanout, kept_every):
    """Sources of one leaf, of exact powers and beyond, odd names, ties, nulls and copies."""
    sizes = {"one": 1, "two": 2, "": 3, "é": 16, "z": 17, "A": 27, "hot": 300, None: 9}
    rows = [(d, s, f"text {d}") for s, n in sizes.items() for d in range(n)]
    rows += [(3, "z", "another text"), (3, "z", "text 3"), (None, "z", "no id"), (None, "z", None), (5, "new\nline", "")]
    docs = _source(make_docs, rows).withColumns({"place": F.lit("own"), "digest": F.lit(1), "extra": F.col("doc_id") + 1})
    manifest = merkle.build(docs, carried=("extra",), fanout=fanout, kept_every=kept_every)
    proven = merkle.proofs(manifest, fanout, kept_every).withColumns(
        {"folded": merkle.fold(F.col("leaf"), F.col("path")), "proof": merkle.proof_digest(F.col("path"))}
    )
    found = proven.collect()
    assert sorted(
        (str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, r.proof) for r in found
    ) == _plain_manifest(rows, fanout)
    assert all(r.folded == r.root == manifest.root() for r in found)
    assert all(r.extra == r.doc_id + 1 for r in found if r.doc_id is not None)
    assert {r.source: r.subroot for r in manifest.subroots().collect()} == {r.source: r.subroot for r in found}


def test_levels_in_between_are_not_stored(make_docs):
    rows = [(d, "a", str(d)) for d in range(70)]
    manifest = merkle.build(_source(make_docs, rows), fanout=2, kept_every=3)
    assert [level.count() for level in manifest.sources.levels] == [9, 2]
    assert manifest.sources.tops.count() == 1


def test_manifest_of_nothing_and_of_one_row(make_docs):
    nothing = merkle.build(_source(make_docs, []))
    assert nothing.root() is None and merkle.proofs(nothing).count() == 0
    single = merkle.build(_source(make_docs, [(1, "a", "x")]))
    row = merkle.proofs(single).first()
    assert row.leaf == row.subroot == row.root == single.root() and row.path == []


def test_a_changed_column_is_noticed(make_docs):
    docs = _source(make_docs, [(d, "ab"[d % 2], f"Text {d}") for d in range(40)])
    changed = docs.withColumns({name: merkle.leaf_digest({name: F.lit("0")}) for name in ("lang", "n_chars")})
    proven = merkle.proofs(merkle.build(changed.withColumnRenamed("lang", "by_lang").withColumn("lang", F.lit("en"))
                                        .withColumnRenamed("n_chars", "by_size").withColumn("n_chars", F.length("text")),
                                        carried=("by_lang", "by_size")))
    for name in ("by_lang", "by_size"):
        assert proven.where(merkle.fold(F.col(name), F.col("path")) == F.col("root")).count() == 0
    assert proven.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
