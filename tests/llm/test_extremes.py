"""Very long texts, repeated rows and empty tables, for the operators without such tests of their own."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardlight.llm import chat, common, language_id, packing, quality_classifier, quality_rules

ROOT = Path(__file__).resolve().parents[2]
LONG = " ".join(f"w{i % 977}" for i in range(120_000))


@pytest.fixture(scope="module")
def labelled(make_docs):
    texts = {d: ("plain words of a good text " if d % 2 else "buy now !!! $$$ ") * (5 + d) for d in range(60)}
    docs = make_docs(texts)
    return docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def test_quality_scores_of_odd_rows(labelled, make_docs):
    model = quality_classifier.fit(*labelled)
    rows = [(1, LONG), (2, None), (3, ""), (4, "plain words"), (4, "plain words"), (None, "plain words")]
    docs = make_docs(rows).withColumns({"score": F.lit("own"), "quality": F.lit(1)})
    found = quality_classifier.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    scores = {}
    for row in found:
        scores.setdefault(row.doc_id, set()).add(row.score)
    assert len(scores[4]) == 1 and scores[4] == scores[None] and scores[2] == scores[3]
    assert all(0 <= row.score <= 1 for row in found)
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    empty = quality_classifier.fit(docs.limit(0), labelled[1])
    assert {r.score for r in quality_classifier.score(docs, empty).collect()} == {0.5}


def test_counts_of_a_long_text(make_docs):
    row = quality_rules.counts(make_docs({1: LONG})).first()
    assert row.n_words == 120_000 and row.word_chars == len(LONG) - 119_999
    assert row.n_repeat_words == 120_000 and row.n_dup_lines == 0


def test_a_long_message_is_formatted_whole(spark):
    text = "<|im_end|>" + LONG
    table = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_paths(chat.threads(table))
    turns = formatted.select(chat.parse(F.col("formatted")).alias("turns")).first().turns
    assert [t.text for t in turns] == [text, text]


def test_a_long_text_is_packed_whole(make_docs):
    rows = packing.pack(make_docs({1: LONG, 2: ""}).select("doc_id", "text")).collect()
    assert packing.pack(make_docs({}).select("doc_id", "text")).count() == 0
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1)
    assert [p for p, _, _ in pieces] == list(range(len(pieces)))
    assert all(start == sum(n for _, _, n in pieces[:i]) for i, (_, start, _) in enumerate(pieces))
    assert sum(n for _, _, n in pieces) > 120_000 and all(n == 1024 for _, _, n in pieces[1:])


def test_language_of_a_long_text(spark, make_docs):
    rows = [(LONG, "x"), ("ééé èè éèé " * 50, "y")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    found = language_id.identify(make_docs({1: LONG, 2: brute.characters(LONG), 3: "éé èé"}), model)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "x", 2: "x", 3: "y"}
    assert language_id.identify(make_docs({}), model).count() == 0


def test_task_functions_get_bounded_batches_and_leave_no_memory(spark, make_docs):
    """A batch of texts has a bounded size, and freed memory goes back to the system."""

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    docs = make_docs({i: "x" * 10_000 for i in range(2000)}).coalesce(1).select("doc_id", "text")
    rows = common.mapped(docs, task, "rows long, bytes long").collect()
    assert sum(r.rows for r in rows) == 2000 and max(r.bytes for r in rows) < 2 * common.BATCH_BYTES
    assert _memory_kept("common.trimmed(fragments)") < _memory_kept("fragments") / 2


_FRAGMENTS = """
import ctypes, re
from wardlight.llm import common
libc = ctypes.CDLL(None)
libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()).group(1))

def fragments(batches):
    # Frees all of many small blocks but the last, which holds the C library's heap up.
    blocks = [libc.malloc(10_000) for _ in range(20_000)]
    for block in blocks:
        ctypes.memset(block, 1, 10_000)
    for block in blocks[:-1]:
        libc.free(block)
    yield None

before = resident()
list(TASK([]))
print(resident() - before)
"""


def _memory_kept(task: str) -> int:
    """What a process of its own holds more after the task function than before, in kB."""
    code = _FRAGMENTS.replace("TASK", task)
    return int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True, cwd=ROOT).stdout)
