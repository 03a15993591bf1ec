"""Quality rules as a short-circuit cascade, with DataFrame operations only.

Each rule names the condition that rejects a text and what evaluating it costs:
a price per unit (characters, words or lines) times the units it visits. One
aggregate over a sample gives every rule's mean cost and rejection rate; the
rules are then tried in the order of rejections per cost, and a text that one
rule rejects never evaluates the next. The order changes cost, not verdicts:
every order rejects the same texts.

Null and empty texts have no words; the counts are 0 and no ratio rule fires.
Repeated rows are judged one by one, columns of the input are kept. Very long texts are read
whole: every count is an aggregate of one row's arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import SPACES, let

#: Characters of `[\x20\x09-\x0D]`, for trimming.
_SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Words in a window of the repetition count.
WINDOW = 8
#: Texts the cost and selectivity estimate looks at, about.
SAMPLE_TEXTS = 5000


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text to drop; `units` times `unit_cost` estimates its cost."""

    name: str
    rejects: Column
    units: Column
    unit_cost: float


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a text of white space."""
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))


def matches(text: Column, pattern: str) -> Column:
    """Characters of the class `pattern` in the text."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACE_CHARS)) != "")


def repeat_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at these ascending positions."""
    reach = F.transform(
        starts,
        lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW))),
    )
    return F.aggregate(reach, F.lit(0), lambda total, n: total + n)


def _repeat_starts(hashes: Column) -> Column:
    """Ascending positions of the values that occur twice or more."""

    def kept(pairs):
        def twice(pair, i):
            before = F.get(pairs, F.when(i > 0, i - 1).otherwise(F.lit(-1))).value
            after = F.get(pairs, i + 1).value
            same = F.coalesce(before == pair.value, F.lit(False)) | F.coalesce(after == pair.value, F.lit(False))
            return F.when(same, pair.at)

        return F.array_sort(F.filter(F.transform(pairs, twice), lambda at: at.isNotNull()))

    pairs = F.transform(hashes, lambda value, i: F.struct(value.alias("value"), i.alias("at")))
    return let(F.sort_array(pairs), kept)


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. The positions are
    sorted only in texts that do repeat a window.
    """

    def count(ws):
        places = F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1))
        hashes = F.transform(places, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
        repeated = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(_repeat_starts(h), _covered)
            ),
        )
        return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(repeated)

    return let(words, count).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """The texts with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Columns of these names in the input are replaced.
    """
    text = whole_text(F.col("text"))

    def measured(ws):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            matches(text, "[#*$%&|<>]").alias("n_symbols"),
            repeat_lines(text).alias("n_dup_lines"),
            repeat_words(ws).alias("n_repeat_words"),
        )

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [name for name in docs.columns if name not in names]
    return docs.withColumn("__counts", let(words_of(text), measured)).select(*kept, "__counts.*")


def standard_rules() -> list[Rule]:
    """Ratio rules on `text` and the columns of `counts`; thresholds are fixed values."""
    text = whole_text(F.col("text"))
    chars, words = F.char_length(text).cast("double"), F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words, F.lit(1.0), 1.0),
        Rule("short_words", F.col("word_chars") < 2 * words, F.lit(1.0), 1.0),
        Rule("long_words", F.col("word_chars") > 15 * words, F.lit(1.0), 1.0),
        Rule(
            "repeated_lines",
            10 * F.col("n_dup_lines") > 3 * let(worded_lines(text), F.size),
            chars,
            2.0,
        ),
        Rule("exclamations", 5 * matches(text, "!") > words, chars, 5.0),
        Rule("capitals", 10 * matches(text, r"\p{Lu}") > 3 * F.col("word_chars"), chars, 12.0),
    ]


def ordered(
    rules: list[Rule],
    docs: DataFrame,
    sample_texts: int = SAMPLE_TEXTS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> list[Rule]:
    """The rules by rejections per cost, measured on about `sample_texts` texts.

    `prepare` adds the columns that rules read, to the sampled rows only. Equal ratios
    keep the given order, as an empty table does.
    """
    if not rules:
        return []
    total = docs.count()
    part = docs if total <= sample_texts else docs.sample(fraction=sample_texts / total, seed=7)
    row = (prepare(part) if prepare else part).agg(
        *[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)],
        *[F.avg(r.units * r.unit_cost).alias(f"c{i}") for i, r in enumerate(rules)],
    ).first()
    gain = [(row[f"r{i}"] or 0.0) / max(row[f"c{i}"] or 0.0, 1e-9) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def cascade(
    docs: DataFrame,
    rules: list[Rule],
    sample_texts: int = SAMPLE_TEXTS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows, prepared, with `failed_rule`, the first rule that rejects the text, null if none does.

    A CASE expression stops at its first true branch, so later rules are not
    evaluated for rejected texts.
    """
    verdict = None
    for rule in ordered(rules, docs, sample_texts, prepare):
        condition = F.coalesce(rule.rejects, F.lit(False))
        verdict = (F if verdict is None else verdict).when(condition, F.lit(rule.name))
    if verdict is None:
        verdict = F.lit(None).cast("string")
    return (prepare(docs) if prepare else docs).withColumn("failed_rule", verdict)
