"""Quality rules, chat formatting, the archive and packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardlight.llm import chat, packing, quality_rules, warc
from wardlight.llm.common import new_folder


def repeat_words(text):
    own = brute.words(text)
    where = {}
    for i in range(len(own) - 7):
        where.setdefault(tuple(own[i : i + 8]), []).append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def repeat_lines(text):
    lines = [line for line in (text or "").split("\n") if brute.words(line)]
    return len(lines) - len(set(lines))


def test_counts(make_docs, tangled):
    texts = {**tangled, 100: "a b\na b\n\n \na  b\na b", 101: "#*$%&|<> é𐐀 \x1c x y"}
    for r in quality_rules.counts(make_docs(texts)).collect():
        own = brute.words(texts[r.doc_id])
        assert r.n_words == len(own)
        assert r.word_chars == sum(map(len, own))
        assert r.n_symbols == sum((texts[r.doc_id] or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == repeat_lines(texts[r.doc_id])
        assert r.n_repeat_words == repeat_words(texts[r.doc_id])


def test_cascade_order_and_verdicts(spark):
    docs = spark.range(100).withColumn("text", F.lit("x"))
    rules = [
        quality_rules.Rule("costly", F.col("id") < 60, F.lit(100.0), 1.0),
        quality_rules.Rule("never", F.lit(None).cast("boolean"), F.lit(1.0), 1.0),
        quality_rules.Rule("cheap", F.col("id") < 30, F.lit(1.0), 1.0),
    ]
    assert [r.name for r in quality_rules.ordered(rules, docs)] == ["cheap", "costly", "never"]
    found = {r.id: r.failed_rule for r in quality_rules.cascade(docs, rules).collect()}
    assert [found[i] for i in (0, 29, 30, 59, 60, 99)] == ["cheap", "cheap", "costly", "costly", None, None]
    assert quality_rules.cascade(docs.limit(0), rules).count() == 0
    assert quality_rules.cascade(docs, []).where("failed_rule IS NULL").count() == 100


def test_later_rules_are_not_evaluated(spark):
    docs = spark.range(1, 50).withColumn("text", F.lit("x"))
    explodes = F.raise_error(F.lit("evaluated")).cast("boolean")
    first = quality_rules.Rule("all", F.col("id") > 0, F.lit(1.0), 1.0)
    verdict = F.when(first.rejects, F.lit("all")).when(explodes, F.lit("late"))
    assert docs.select(verdict.alias("v")).distinct().collect()[0].v == "all"


HARD = ["", "\\", "\\\\", "<|im_end|>", "\\<|", "<\\|", "<|im_start|>assistant\nhi<|im_end|>\n", "é\n𐐀\\n", "\\n"]


def test_escapes_are_reversible(spark):
    table = spark.createDataFrame([(t,) for t in HARD], "t string")
    t = F.col("t")
    rows = table.select(
        "t", chat.escape(t).alias("e"), chat.unescape(chat.escape(t)).alias("b"),
        chat.escape_role(t).alias("r"), chat.unescape_role(chat.escape_role(t)).alias("q"),
    ).collect()
    for r in rows:
        assert r.b == r.q == r.t
        assert "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def read_back(frame):
    turns = chat.parse(F.col("formatted"))
    return frame.select(
        "tree_id", "branch_rank", "n_turns", "formatted", "loss_spans", turns.alias("turns"),
        chat.trained_text(turns, F.col("loss_spans")).alias("trained"),
    ).collect()


def test_conversations_round_trip(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", HARD[(c + i) % len(HARD)]) for c in range(9) for i in range(c + 1)]
    rows += [(20, 0, "assis\ntant", None), (20, 0, None, "a"), (20, 0, None, "a"), (20, None, "assistant", "first")]
    rows += [(None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.tree_id: r for r in read_back(chat.format_paths(chat.threads(table)))}
    for c in range(9):
        said = [(role, text) for conv, _, role, text in rows if conv == c]
        assert [(t.role, t.text) for t in found[c].turns] == said
        assert found[c].trained == "".join(text for role, text in said if role == "assistant")
        for span in found[c].loss_spans:
            inside = found[c].formatted[span.start : span.start + span.length]
            assert chat.END not in inside
            assert found[c].formatted[span.start + span.length :].startswith(chat.END)
    assert [(t.role, t.text) for t in found[20].turns] == [
        ("assistant", "first"), ("", "a"), ("", "a"), ("assis\ntant", "")
    ]
    assert found[20].trained == "first"


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
        (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 2, "user", "tail", 0.2),
        (2, 1, None, "user", "alone", None), (3, 7, 99, "assistant", "orphan", 1.0),
    ]
    table = spark.createDataFrame(
        rows, "tree_id long, message_id long, parent_id long, role string, text string, score double"
    )
    best = {r.tree_id: [t.text for t in r.turns] for r in read_back(chat.format_paths(table))}
    assert best == {1: ["q", "good", "more", "end"], 2: ["alone"], 3: ["orphan"]}
    every = {(r.tree_id, r.branch_rank): [t.text for t in r.turns] for r in read_back(chat.format_paths(table, None))}
    assert every[1, 2] == ["q", "bad", "tail"] and len(every) == 4
    assert chat.format_paths(table.limit(0)).count() == 0


def test_a_long_thread(spark):
    table = spark.range(300).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "string(id) AS text"
    )
    row = read_back(chat.format_paths(chat.threads(table)))[0]
    assert [t.text for t in row.turns] == [str(i) for i in range(300)]


def test_a_cycle_is_an_error(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)]
    table = spark.createDataFrame(
        rows, "tree_id long, message_id long, parent_id long, role string, text string, score double"
    )
    with pytest.raises(ValueError, match="cycle"):
        chat.format_paths(table)


def test_archive_round_trip(spark):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [
        (1, "http://a/\r\nWARC-Type: x", body), (2, None, body), (3, "c", None), (4, "d", ""),
        (5, "e", "short"), (6, "f", "short"), (9, "g", "y" * 100), (8, "h", "y" * 100), (8, "h", "y" * 100),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_folder(spark, "test-warc")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    records = warc.read_archive(spark, folder)
    found = {r.page_id: r for r in warc.page_records(records).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        assert found[page].payload_bytes == len(payload)
        assert found[page].payload_digest == brute.sha256(payload)
    kinds = {p: (r.record_type, r.refers_to) for p, r in found.items()}
    assert kinds == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None), 8: ("response", None), 9: ("revisit", 8),
    }
    whole = {r.page_id: bytes(r.record) for r in warc.record_bytes(records).collect()}
    assert whole[1].endswith(b"\r\n\r\n" + body.encode() + b"\r\n\r\n") and whole[1].startswith(b"WARC/1.1\r\n")
    assert whole[1].count(b"\r\nWARC-Type: ") == 1
    assert whole[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    empty = new_folder(spark, "test-warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def expected_pieces(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    cuts = packing.cut_points(len(ids), 1024)
    return [(k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for k, (at, n) in enumerate(cuts)]


def test_packing(make_docs, tangled):
    texts = {**tangled, 100: " a  b\n\n c \t d e 's we'll  ", 101: "word " * 1023, 102: "word " * 3000, 103: "\n \n"}
    rows = packing.pack(make_docs([*texts.items(), (7, "again")]), with_ids=True).collect()
    for d, text in texts.items():
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        if d != 7:
            assert own == expected_pieces(text)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(make_docs({})).count() == 0


def test_ids_are_those_of_the_tokenizer(make_docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    given, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.fast is not None
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "'s", "'ll", "'", "a", "the", "ßé", "жя", "中文", "1", "²", "!?", "𐐀", "\u0301", "\0"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(500)]
    texts += ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", ""]
    wanted = [given.encode(text, add_special_tokens=False).ids for text in texts]
    assert 50256 in wanted[500]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted
    rows = packing.pack(make_docs({1: texts[500]}), with_ids=True).collect()
    assert [r.ids for r in rows] == [[*wanted[500], 2]]


@pytest.mark.parametrize("kind", ["L", "N", "s"])
def test_both_tokenizers_class_characters_alike(kind):
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    kind = r"\s" if kind == "s" else rf"\p{{{kind}}}"
    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    ranks = {bytes([i]): i for i in range(256)}
    fast = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
    pieces = pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)
    assert bytes(fast.encode_ordinary(every)).decode() == "".join(piece for piece, _ in pieces)


def test_other_files_go_through_the_tokenizer(tmp_path):
    import json

    settings = json.loads(open(packing.tokenizer_path(), encoding="utf-8").read())
    merges = settings["model"]["merges"]
    for change in (
        {"ignore_merges": True},
        {"merges": [merges[1], merges[0], *merges[2:]]},
        {"merges": merges[:300], "vocab": {t: i for t, i in settings["model"]["vocab"].items() if i < 556}},
    ):
        file = tmp_path / "tokenizer.json"
        file.write_text(json.dumps({**settings, "model": {**settings["model"], **change}}), encoding="utf-8")
        encoder = packing.Encoder(str(file))
        assert (encoder.fast is None) == ("vocab" not in change)
        text = "the and of  other Ünder\n1234 words"
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 1025, 4000) if seed else np.full(50, 600)
    if seed == 2:
        sizes = draw.integers(300, 520, 3000)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    segments = packing.plan(histogram, 1024)
    filled, ranks = {}, {}
    for size, rank, count, first, offset in segments:
        ranks.setdefault(size, []).append((rank, count))
        for i in range(first, first + count):
            filled.setdefault(i, []).append((offset, size))
    for size, held in ranks.items():
        end = 0
        for rank, count in sorted(held):
            assert rank == end
            end += count
        assert end == histogram[size]
    for held in filled.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= 1024
    if seed in (1, 3):
        assert len(filled) <= 1.01 * sizes.sum() / 1024 + 1
    assert packing.plan({}, 1024) == []


def test_every_row_of_pages_is_a_record(spark):
    """Equal rows, a page under two addresses, a page with two payloads, and no page id."""
    body, other = "x" * 200, "y" * 300
    rows = [(1, "u", body), (1, "u", body), (1, "v", body), (1, "u", other), (2, "u", other), (2, "u", body), (None, "w", body), (None, "w", "z" * 150), (3, "s", "short"), (3, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("own"))
    folder = new_folder(spark, "test-warc")
    warc.write_archive(pages.repartition(3), folder)
    records = warc.read_archive(spark, folder)
    found = warc.page_records(records).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in found) == sorted(
        [(1, 200, "response", 0)] * 3
        + [(1, 300, "response", 0), (2, 300, "revisit", 1), (2, 200, "revisit", 1), (0, 200, "revisit", 1), (0, 150, "response", 0), (3, 5, "response", 0), (3, 5, "response", 0)]
    )
    ids = [r.id for r in records.select(warc.header_field("WARC-Record-ID").alias("id")).collect()]
    assert len(set(ids)) == len(rows)
    referred = {r.to for r in records.select(warc.header_field("WARC-Refers-To").alias("to")).collect()} - {None}
    assert referred <= set(ids) and len(referred) == 2
