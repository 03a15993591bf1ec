"""Language identification with interpolated Kneser-Ney character models.

One model per language over the 4-grams of lower-cased letters; anything else
is one space. Every training text counts, and no n-gram is dropped. Tasks count the 4-grams
of their rows and Spark adds them up. What the recursion over the orders needs of an n-gram
is then one table of facts: counts of 4-grams, continuation counts of the lower orders
(distinct n-grams that end with them), and sums and kinds by context. It grows with the corpus.

The frequent 4-grams' probabilities are sent to the tasks as sorted hash arrays beside a matrix with
a column per language, `CELLS` numbers at most. Other 4-grams of a text, rare or never
seen, are listed by the task; each distinct one is looked up once in the table of facts,
with its contexts and lower orders in the same join, and the lists are joined with the results.

At order 1 the mass that discounting leaves is spread evenly over all characters of
the training texts and one that stands for any other, so the probabilities of the characters that
may follow a context add up to one.

A text's language is the one with the lowest cross-entropy per character, ties
going to the alphabetically first. Rejection is calibrated on all training texts of
each language: a text is rejected if its cross-entropy lies `Z_LIMIT` standard
deviations above what its language shows for texts of that length. The medians this takes
are exact, found digit by digit from counts.

Texts that are null or without a letter are `und`, with score 0, and rejected.
Without training rows every text is `und`. Very long texts are read whole, in a block of their own.
Rows are judged one by one: those that repeat, share an id or have none get their own verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from wardlight.llm.common import mapped, released, stored, text_blocks
from wardlight.llm.words import mixed

ORDER = 4
#: Numbers in the matrix that is sent to the tasks, at most.
CELLS = 1 << 22
Z_LIMIT = 10.0
#: Characters from which a text's cross-entropy tells what is usual, unless half of the texts are shorter.
LONG_CHARS = 200
#: Cross-entropies are compared in units of 2 ** -32, in digits of 11 bits.
_UNIT = 1 << 32
_DIGIT = 11
_DIGITS = 4
#: Least spread between texts of a language, as a share of its cross-entropy.
LEAST_SPREAD = 0.05
#: Characters beyond which a longer text adds no confidence to the score.
CONFIDENT_CHARS = 60
#: Characters that are looked at together, about.
BLOCK_CHARS = 1 << 18
_SPACE = 32
#: Bits of a character; a 4-gram is two numbers of two characters each.
_BITS = 21
_LAST = (1 << _BITS) - 1


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def _grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-grams of the texts as their first and last two characters, and how many each text has.

    Each text is padded with three spaces and has no n-gram if it has no letter.
    """
    joined = "\0".join([text.lower() for text in texts]) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(points == 0)
    if len(ends) != len(texts):  # a text holds the separator itself
        joined = "\0".join([text.lower().replace("\0", " ") for text in texts]) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        ends = np.flatnonzero(points == 0)
    letter = letters[np.minimum(points, 0xFFFF)]
    astral = points > 0xFFFF
    if astral.any():
        kinds, which = np.unique(points[astral], return_inverse=True)
        letter[astral] = np.array([chr(k).isalpha() for k in kinds])[which]
    after_letter = np.empty_like(letter)
    after_letter[0] = False
    after_letter[1:] = letter[:-1]
    keep = letter | after_letter
    kept = np.where(letter, points, _SPACE)[keep].astype(np.int64)
    per_text = np.diff(np.cumsum(keep)[ends], prepend=0)
    # Texts without a letter keep no character.
    pad = ORDER - 1
    row = np.repeat(np.arange(len(texts)), per_text)
    padded = np.full(len(kept) + pad * len(texts), _SPACE, np.int64)
    padded[np.arange(len(kept)) + pad * (row + 1)] = kept
    pairs = padded[:-1] << _BITS | padded[1:]
    # The n-gram that ends at kept character j starts pad characters earlier.
    start = np.arange(len(kept)) + pad * row
    return pairs[start], pairs[start + 2], per_text


def _hashes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of 4-grams."""
    return mixed(mixed(first.view(np.uint64)) + last.view(np.uint64))


def _distinct(first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 4-grams with their counts added up."""
    _, at, which = np.unique(_hashes(first, last), return_index=True, return_inverse=True)
    return first[at], last[at], np.bincount(which, counts, len(at)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-gram counts by language of a task's rows."""
    letters = _letter_table()
    held: dict[str, list] = {}
    size = 0

    def merged(parts):
        return _distinct(*(np.concatenate(column) for column in zip(*parts, strict=True)))

    def out():
        for lang, parts in held.items():
            columns = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(columns[0]), pa.string()), *map(pa.array, columns)],
                names=["lang", "first", "last", "n"],
            )
        held.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for start, end in text_blocks(own, BLOCK_CHARS):
                first, last, _ = _grams(own[start:end], letters)
                part = _distinct(first, last, np.ones(len(first), np.int64))
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if len(held[lang]) > 32:
                    before = sum(len(g[0]) for g in held[lang])
                    held[lang] = [merged(held[lang])]
                    size += len(held[lang][0][0]) - before
        if size > 2_000_000:
            yield from out()
            size = 0
    yield from out()


# Kinds of facts: counts of the orders 4, 3, 2, 1, and contexts of the orders 4, 3, 2.
_COUNTS, _CONTEXTS = (0, 2, 4, 6), (1, 3, 5)


def _keys() -> list[tuple]:
    """Per kind of fact the two numbers by which a 4-gram (first, last) finds it."""
    first, last = F.col("first"), F.col("last")
    none, second, before = F.lit(0).cast("long"), first.bitwiseAND(F.lit(_LAST)), F.shiftright(last, _BITS)
    return [
        (first, last),
        (first, before),
        (second, last),
        (second, before),
        (none, last),
        (none, before),
        (none, last.bitwiseAND(F.lit(_LAST))),
    ]


def _facts(grams: DataFrame) -> DataFrame:
    """(kind, a, b, by): of all n-grams and contexts, the languages' (n, kinds) as a map by number."""

    def reduced(level: DataFrame, kind: int, n) -> DataFrame:
        a, b = _keys()[kind]
        return level.groupBy("lang", a.alias("first"), b.alias("last")).agg(
            n.cast("long").alias("n"), F.count("*").alias("kinds")
        )

    def as_facts(level: DataFrame, kind: int) -> DataFrame:
        kinds = F.col("kinds") if "kinds" in level.columns else F.lit(0).cast("long")
        return level.select(F.lit(kind).alias("kind"), F.col("first").alias("a"), F.col("last").alias("b"), "lang", "n", kinds.alias("kinds"))

    levels = {0: grams}
    for kind in _COUNTS[1:]:
        # An n-gram of a lower order counts once for each n-gram of the order above that ends with it.
        levels[kind] = reduced(levels[kind - 2], kind, F.count("*"))
        if kind == 2:
            levels[kind] = stored(levels[kind], "language-trigrams")
    parts = [as_facts(level, kind) for kind, level in levels.items()]
    parts += [as_facts(reduced(levels[kind - 1], kind, F.sum("n")), kind) for kind in _CONTEXTS]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    by = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("n", "kinds"))))
    facts = stored(every.groupBy("kind", "a", "b").agg(by.alias("by")), "language-facts")
    released(levels[2])
    return facts


@dataclass
class LanguageModel:
    """The facts of all n-grams, and the frequent 4-grams as the tasks get them."""

    langs: list[str]
    limits: dict[str, tuple[float, float, float]]
    facts: DataFrame | None = None
    discounts: list[list[float]] | None = None  # by order, 4 first, and language
    gram_totals: list[float] | None = None  # of order 4, by language
    totals: list[float] | None = None  # of order 1, by language
    kinds: list[float] | None = None  # distinct characters, by language
    characters: int = 1  # distinct ones of all languages, and one for any other
    frequent: Broadcast | None = None  # (sorted hashes, log-probabilities by language)

    def chances(self, grams: DataFrame) -> DataFrame:
        """(first, last, chance) of distinct 4-grams, seen or not: an array with a probability per language."""
        keys = F.array(
            *[F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")) for kind, (a, b) in enumerate(_keys())]
        )
        asked = grams.select("first", "last", F.explode(keys).alias("key")).select("first", "last", "key.*")
        # Contexts and short n-grams are asked for by many: each distinct one is looked up once a task.
        found = asked.join(self.facts, ["kind", "a", "b"], "left")
        told = found.groupBy("first", "last").agg(
            F.map_from_entries(
                F.collect_list(F.when(F.col("by").isNotNull(), F.struct("kind", "by")))
            ).alias("facts")
        )

        def chance(i: int):
            def fact(kind: int, field: str):
                return F.coalesce(F.try_element_at(F.try_element_at("facts", F.lit(kind)), F.lit(i))[field], F.lit(0))

            rest = self.discounts[-1][i] * self.kinds[i] / self.characters
            value = (F.greatest(fact(6, "n") - self.discounts[-1][i], F.lit(0.0)) + rest) / self.totals[i]
            for order, kind in ((2, 5), (1, 3), (0, 1)):
                discount, total = self.discounts[order][i], fact(kind, "n")
                seen = F.greatest(fact(kind - 1, "n") - discount, F.lit(0.0))
                value = F.when(total == 0, value).otherwise((seen + fact(kind, "kinds") * discount * value) / total)
            return value

        return told.select("first", "last", F.array(*[chance(i) for i in range(len(self.langs))]).alias("chance"))

    def decide(self, entropy: np.ndarray, lengths: np.ndarray) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and rejection by cross-entropies and characters."""
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(lengths)), best]
        certain = np.minimum(lengths, CONFIDENT_CHARS)[:, None]
        score = 1 / np.exp(-(entropy - lowest[:, None]) * certain / 4).sum(axis=1)
        langs, rejected = [], []
        for i, n in enumerate(lengths.tolist()):
            lang = self.langs[best[i]] if n else "und"
            langs.append(lang)
            middle, spread, within = self.limits.get(lang, (np.inf, 0, 0))
            rejected.append(n == 0 or bool(lowest[i] > middle + Z_LIMIT * np.sqrt(spread**2 + within / n)))
        return langs, np.where(lengths > 0, score, 0.0), rejected



def fit(training: DataFrame, cells: int = CELLS, calibration_texts: int | None = None) -> LanguageModel:
    """A model from the rows (text, lang); rows with a null in either teach nothing.

    Every training text calibrates. `calibration_texts` is still accepted and limits nothing.
    """
    rows = _as_text(training.select("text", "lang"))
    model = _learned(rows, cells)
    if model.langs:
        model.limits = _limits(measured(rows.where(_TEACHES), model), model.langs)
    return model


#: Of rows (text, lang), those that teach.
_TEACHES = "text IS NOT NULL AND lang IS NOT NULL"


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("string") for name in ("text", "lang")})


def _learned(rows: DataFrame, cells: int) -> LanguageModel:
    """A model without limits."""
    rows = rows.select("text", "lang").where(_TEACHES)
    langs = sorted(row["lang"] for row in rows.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], {})
    counted = mapped(rows, _count, "lang string, first long, last long, n long")
    grams = stored(
        counted.groupBy(_number(langs).alias("lang"), "first", "last").agg(F.sum("n").alias("n")), "language-grams"
    )
    model = LanguageModel(langs, {}, _facts(grams))
    released(grams)
    _add_totals(model)
    # A share that so many n-grams of a language reach at most, with a row of the matrix each.
    share = len(langs) ** 2 / cells
    least = F.array(*[F.lit(share * total) for total in model.gram_totals])
    often = F.exists(F.map_entries("by"), lambda e: e["value"]["n"] >= least[e["key"]])
    frequent = model.facts.where("kind = 0").where(often).select(F.col("a").alias("first"), F.col("b").alias("last"))
    table = model.chances(frequent).select("first", "last", *[F.log(F.col("chance")[i]).cast("float").alias(f"log{i}") for i in range(len(langs))]).toArrow()
    columns = [table.column(i).to_numpy() for i in range(2 + len(langs))]
    hashes = _hashes(*columns[:2])
    order = np.argsort(hashes)
    logs = np.column_stack(columns[2:]).astype(np.float32)[order]
    model.frequent = rows.sparkSession.sparkContext.broadcast((hashes[order], logs))
    return model


def _number(langs: list[str]):
    """The number of the language in `lang`, null for none."""
    return F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])[F.col("lang")]


def _add_totals(model: LanguageModel) -> None:
    """Discounts and totals by order and language, and how many characters there are."""
    entry = F.explode(F.map_entries("by")).alias("entry")
    n = F.col("entry.value.n")
    counts = model.facts.where(F.col("kind").isin(*_COUNTS)).select("kind", entry)
    sums = counts.groupBy("kind", F.col("entry.key").alias("lang")).agg(
        F.sum(n).alias("total"),
        F.count("*").alias("kinds"),
        F.count_if(n == 1).alias("once"),
        F.count_if(n == 2).alias("twice"),
    )
    found = {(row["kind"], row["lang"]): row for row in sums.collect()}
    numbers = range(len(model.langs))
    nothing = {"total": 1, "kinds": 0, "once": 0, "twice": 0}

    def discount(row) -> float:
        once, twice = row["once"], row["twice"]
        return once / (once + 2 * twice) if once and twice else 0.5

    rows = [[found.get((kind, i), nothing) for i in numbers] for kind in _COUNTS]
    model.discounts = [[discount(row) for row in order] for order in rows]
    model.gram_totals = [float(row["total"]) for row in rows[0]]
    model.totals = [float(row["total"]) for row in rows[-1]]
    model.kinds = [float(row["kinds"]) for row in rows[-1]]
    model.characters = model.facts.where(F.col("kind") == _COUNTS[-1]).count() + 1


def _limits(found: DataFrame, langs: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, spread and variance per character of the cross-entropy, by language.

    From all measured rows with a `lang` and a letter, each by its own language.
    """
    own = found.where("n > 0").select(_number(langs).alias("lang"), "n", "sums", "squares").where("lang IS NOT NULL")
    mean, square = (F.get(name, F.col("lang")) / F.col("n") for name in ("sums", "squares"))
    units = F.least(F.greatest(F.round(-mean * _UNIT), F.lit(0)).cast("long"), F.lit((1 << _DIGIT * _DIGITS - 1) - 1))
    variance = F.greatest(square - mean * mean, F.lit(0.0))
    own = stored(own.select("lang", "n", units.alias("units"), variance.alias("variance")), "language-entropies")
    within = own.groupBy("lang").agg((F.sum(F.col("variance") * F.col("n")) / F.sum("n")).alias("within")).collect()
    within = {row["lang"]: float(row["within"]) for row in within}
    if not within:
        released(own)
        return {}

    def of_lang(values: dict[int, float]):
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    # Above twice the limit, how long a text is does not matter to the lesser of limit and median.
    lengths = _medians(own.select("lang", F.least("n", F.lit(2 * LONG_CHARS)).alias("value")), 1)
    least = of_lang({lang: float(min(LONG_CHARS, length)) for lang, length in lengths.items()})
    long = own.where(F.col("n") >= least)
    middles = _medians(long.select("lang", F.col("units").alias("value")), _DIGITS)
    # Medians may lie between two units, so deviations count in halves.
    halves = F.abs(F.col("units") * 2 - of_lang({lang: int(2 * middle) for lang, middle in middles.items()}))
    spreads = _medians(long.select("lang", halves.alias("value")), _DIGITS)
    released(own)
    limits = {}
    for lang, middle in middles.items():
        middle /= _UNIT
        spread = 1.4826 * spreads[lang] / 2 / _UNIT
        limits[langs[lang]] = (middle, max(spread, LEAST_SPREAD * middle), within[lang])
    return limits


def _medians(values: DataFrame, digits: int) -> dict[int, float]:
    """The exact median by language of the rows (lang, value), values being whole and of up to so many digits.

    Rows are counted by language and their first digit, then those that share it with a middle row by the
    next, and so on. Counts combine map-side, and the driver sees 2 * 2 ** _DIGIT of them a language at most.
    """
    # By language, of both middle rows: the digits known, and the place among the rows that have them.
    middles: dict[int, list[tuple[int, int]]] = {}
    for shift in range(_DIGIT * (digits - 1), -1, -_DIGIT):
        part = values
        if middles:
            known = F.create_map(
                *[x for lang, own in middles.items() for x in (F.lit(lang), F.array(*[F.lit(head).cast("long") for head, _ in own]))]
            )[F.col("lang")]
            part = values.where(F.array_contains(known, F.shiftright("value", shift + _DIGIT)))
        counts: dict[int, dict[int, int]] = {}
        for row in part.groupBy("lang", F.shiftright("value", shift).alias("head")).count().collect():
            counts.setdefault(row["lang"], {})[row["head"]] = row["count"]
        if not middles:
            sizes = {lang: sum(own.values()) for lang, own in counts.items()}
            middles = {lang: [(0, (n - 1) // 2), (0, n // 2)] for lang, n in sizes.items()}
        for lang, own in middles.items():
            middles[lang] = [_next_digit(counts[lang], *middle) for middle in own]
    return {lang: (low + high) / 2 for lang, ((low, _), (high, _)) in middles.items()}


def _next_digit(counts: dict[int, int], known: int, place: int) -> tuple[int, int]:
    """The digits with one more of the row at the place, and its place among the rows that have them."""
    heads = sorted(head for head in counts if head >> _DIGIT == known)
    for head in heads:
        if place < counts[head]:
            return head, place
        place -= counts[head]
    raise ValueError("no row at this place")


def _measure(frequent: Broadcast, langs: int):
    """A task function from rows with a `text` to their characters, sums of logarithms, and 4-grams to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        table, known = frequent.value
        ended = np.r_[table, np.uint64(0)]
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            kept = [name for name in batch.schema.names if name != "text"]
            for start, end in text_blocks(texts, BLOCK_CHARS):
                first, last, lengths = _grams(texts[start:end], letters)
                size = len(lengths)
                hashes = _hashes(first, last)
                at = np.searchsorted(table, hashes)
                here = (ended[at] == hashes) & (at < len(table))
                logs = np.zeros((len(hashes), langs), np.float32)
                logs[here], miss = known[at[here]], np.flatnonzero(~here)
                sums, squares = np.zeros((2, size, langs))
                if len(hashes):
                    has = lengths > 0
                    firsts = (np.cumsum(lengths) - lengths)[has]
                    sums[has] = np.add.reduceat(logs, firsts, axis=0, dtype=np.float64)
                    squares[has] = np.add.reduceat(logs * logs, firsts, axis=0, dtype=np.float64)
                owner = np.repeat(np.arange(size), lengths)[miss]
                order = np.lexsort((hashes[miss], owner))
                own, of = hashes[miss][order], owner[order]
                fresh = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])][: len(own)])
                times = np.diff(np.r_[fresh, len(own)])
                place = miss[order][fresh]
                ends = pa.array(np.searchsorted(of[fresh], np.arange(size + 1)), pa.int32())
                rows = pa.array(np.arange(size + 1) * langs, pa.int32())
                lists = [(rows, sums.reshape(-1)), (rows, squares.reshape(-1))]
                lists += [(ends, first[place]), (ends, last[place]), (ends, times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(start, size) for name in kept),
                        pa.array(lengths.astype(np.int64)),
                        *(pa.ListArray.from_arrays(bounds, pa.array(values)) for bounds, values in lists),
                    ],
                    names=[*kept, "n", "sums", "squares", "firsts", "lasts", "times"],
                )

    return run


def measured(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows' columns but `text`; n characters; sums and squares of their log-probabilities by language."""
    schema = StructType(list(rows.drop("text").schema)).add("n", LongType())
    lists = ("sums", DoubleType()), ("squares", DoubleType()), ("firsts", LongType()), ("lasts", LongType())
    for name, kind in (*lists, ("times", LongType())):
        schema = schema.add(name, ArrayType(kind))
    found = mapped(rows, _measure(model.frequent, len(model.langs)), schema)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "language-texts")
    listed = found.select("row", F.explode(F.arrays_zip("firsts", "lasts", "times")).alias("own")).select(
        "row", F.col("own.firsts").alias("first"), F.col("own.lasts").alias("last"), F.col("own.times").alias("times")
    )
    logs = model.chances(listed.select("first", "last").distinct()).select(
        "first", "last", F.transform("chance", lambda c: F.log(c)).alias("logs")
    )
    numbers = range(len(model.langs))
    added = listed.join(logs, ["first", "last"]).groupBy("row").agg(
        F.array(*[F.sum(F.col("times") * F.col("logs")[i]) for i in numbers]).alias("more_sums"),
        F.array(*[F.sum(F.col("times") * F.col("logs")[i] * F.col("logs")[i]) for i in numbers]).alias("more_squares"),
    )

    def with_more(name):
        both = F.zip_with(name, f"more_{name}", lambda a, b: a + b)
        return F.coalesce(both, F.col(name)).alias(name)

    own = [name for name in rows.columns if name != "text"]
    return found.join(added, "row", "left").select(*own, "n", with_more("sums"), with_more("squares"))


def _decide(model: LanguageModel):
    """A task function from measured rows to lang_pred, score and rejected."""
    sent = LanguageModel(model.langs, model.limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            sums = batch.column("sums").flatten().to_numpy().reshape(len(lengths), -1)
            langs, scores, rejected = sent.decide(-sums / np.maximum(lengths, 1)[:, None], lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def _verdicts(found: DataFrame, model: LanguageModel) -> DataFrame:
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return mapped(found.select("doc_id", "n", "sums"), _decide(model), schema)


def _unknown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row with a `text`."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _verdicts(measured(rows, model), model) if model.langs else _unknown(rows)


def fit_and_identify(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """`identify` of the rows (doc_id, text, lang) by a model fitted on those of them that have a `lang`.

    A training text is measured once for its language's limits and for its own verdict.
    """
    rows = _as_text(docs.select("doc_id", "text", "lang"))
    model = _learned(rows, cells)
    if not model.langs:
        return _unknown(rows)
    found = stored(measured(rows, model), "language-measured")
    model.limits = _limits(found, model.langs)
    return _verdicts(found, model)
