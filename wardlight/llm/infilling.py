r"""Fill-in-the-middle rewriting of texts by repeated-capture matching.

A text is a sequence of units, words with the white space before them and white space
at its end: `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`. One full match of
`(unit)*` retains the end of every repetition, so `ends(1)` gives the number of units and
both cut offsets at once. Quantifiers are possessive: no unit can be matched another way,
and a very long text is matched in linear time without a backtracking stack.

The cuts, the share of rewritten texts and their order come from SHA-256 of the seed and
the document's id alone, so rows are independent of each other, of their partition and
of their neighbours.

A null text is empty; an empty text, and one that holds a sentinel, stays plain. A null id is
hashed like an empty one. Rows that repeat are rewritten alike. Columns but doc_id and text are
not read, so any others may be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

from wardlight.llm.common import text_blocks

SEED = 42
#: Texts of a hundred that are rewritten, and of those the ones with the suffix first.
REWRITTEN_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"

UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 that depend on the seed and the id only."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of units and the offsets of both cuts, chosen by two draws."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def rewrite(
    text: str, doc_id: int | None, seed: int, rewritten: int, suffix_first: int
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle characters, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n, a, b = cut(text, h1, h2)
    if not text or h3 % 100 >= rewritten or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, SUFFIX_FIRST, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PREFIX_FIRST, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text an output was made of.

    Rewritten texts hold no mark and marks do not overlap each other, so the first of
    each kind is the one that was put there.
    """
    if form == PLAIN:
        return output
    marks = (SUFFIX, PREFIX) if form == SUFFIX_FIRST else (PREFIX, SUFFIX)
    if not output.startswith(marks[0]):
        raise ValueError(f"an output of form {form} starts with {marks[0]}")
    head, _, rest = output[len(marks[0]) :].partition(marks[1])
    tail, mark, middle = rest.partition(MIDDLE)
    if not mark:
        raise ValueError(f"an output of form {form} holds {marks[1]} and {MIDDLE}")
    return tail + middle + head if form == SUFFIX_FIRST else head + middle + tail


def transform(
    docs: DataFrame,
    seed: int = SEED,
    rewritten_percent: int = REWRITTEN_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for start, end in text_blocks(texts):
                found = [
                    rewrite(text, doc_id, seed, rewritten_percent, suffix_first_percent)
                    for text, doc_id in zip(texts[start:end], ids[start:end], strict=True)
                ]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text AS string) AS text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(rewritten: DataFrame) -> DataFrame:
    """The rows (form, output, ...) with a column `restored`, the exact text before the rewriting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column("output").to_pylist(), batch.column("form").to_pylist()
            for start, end in text_blocks(outputs):
                texts = [rebuild(o, f) for o, f in zip(outputs[start:end], forms[start:end], strict=True)]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "restored"]
                )

    schema = StructType([*rewritten.schema.fields]).add("restored", StringType())
    return rewritten.mapInArrow(run, schema)
