"""Language, quality and decontamination."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardlight.llm import decontamination, language_id, quality_classifier
from wardlight.llm.queries import llm_queries


@pytest.fixture(scope="module")
def language_model(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    return language_id.fit(docs.select("text", "lang"))


def test_language_of_held_out_documents(spark, medium):
    found = llm_queries()["op6_language_id"](spark, medium)
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = found.join(docs, "doc_id").where("held_out AND n_chars > 40").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(language_model, make_docs):
    texts = {1: None, 2: "", 3: "12 $% 34", 4: "of the and that", 5: "qxzj kvwq xjqz zzqx " * 40, 6: "𐐀\0𐐁"}
    rows = {r.doc_id: r for r in language_id.identify(make_docs(texts), language_model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(rows[i].rejected and rows[i].score == 0 for i in (1, 2, 3))
    assert rows[4].lang_pred == "en" and not rows[4].rejected
    assert rows[5].rejected
    assert rows[6].lang_pred != "und"


def _as_grams(spark, grams):
    """4-grams as pairs of characters."""
    codes = [[ord(c) for c in gram] for gram in grams]
    return spark.createDataFrame([(a << 21 | b, c << 21 | d) for a, b, c, d in codes], "first long, last long")


def _chances(model, frame):
    return {
        "".join(chr(n) for pair in (r.first, r.last) for n in (pair >> 21, pair & 0x1FFFFF)): r.chance
        for r in model.chances(frame.distinct()).collect()
    }


TRAINING = {
    "x": ["abab abba baab", "bbba aab", "b a", "12"],
    "y": ["ccc cab", "𐐨𐐩 ш", "Ccc"],
    "z": ["ab 3 ba", "", "жя ab"],
}


def test_chances_by_definition(spark):
    rows = [(t, lang) for lang, texts in TRAINING.items() for t in texts] + [(None, "x"), ("a", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    alphabet = len({c for texts in TRAINING.values() for t in texts for c in brute.characters(t)}) + 1
    grams = {own[i : i + 4] for texts in TRAINING.values() for t in texts
             for own in ["   " + brute.characters(t)] for i in range(len(own) - 3)}
    grams |= {"qqqq", "abqa", "  𐐨q", "ш𐐨𐐩 ", "baba", " cab"}
    found = _chances(model, _as_grams(spark, grams))
    assert set(found) == grams
    for number, lang in enumerate(model.langs):
        plain = brute.CharacterModel(TRAINING[lang], alphabet)
        assert {g: found[g][number] for g in grams} == pytest.approx({g: plain.chance(g) for g in grams}, rel=1e-9)


def test_chances_after_a_context_sum_to_one(spark):
    rows = [(t, lang) for lang, texts in TRAINING.items() for t in texts]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    letters = {c for texts in TRAINING.values() for t in texts for c in brute.characters(t)} | {"q"}
    for context in ("aba", "   ", "c c", "qqq", " 𐐨𐐩"):
        found = _chances(model, _as_grams(spark, [context + c for c in letters]))
        assert [sum(column) for column in zip(*found.values())] == pytest.approx([1.0] * 3, abs=1e-9)


def test_scripts_beyond_the_basic_plane_are_told_apart(spark, make_docs):
    """U+10448 and Cyrillic U+0448 share their low 16 bits."""
    rows = [("\U00010448\U00010449 " * 30, "deseret"), ("шщ " * 30, "cyrillic")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    found = language_id.identify(make_docs({1: "шщ шщ", 2: "\U00010448\U00010449"}), model)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "cyrillic", 2: "deseret"}


def test_what_is_sent_changes_nothing(spark, small, make_docs):
    """The same entropies wherever a 4-gram is held, by definition, and copies and odd rows one by one."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000")
    training = docs.select("text", "lang").limit(60)
    odd = make_docs([(-1, None), (-2, "12"), (-3, "zqxj éß жя " * 9), (-4, "a"), (-4, "and so on"), (None, "and so on")])
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    models = [language_id.fit(training, cells=cells) for cells in (1 << 22, 4000, 1)]
    sizes = [len(model.frequent.value[0]) for model in models]
    assert sizes[0] > 10 * sizes[1] > 10 and sizes[2] == 0
    rows = [
        {(r.doc_id, r.n, tuple(round(v, 3) for v in r.sums)) for r in language_id.measured(both, model).collect()}
        for model in models
    ]
    ids = [{(i, n): sums for i, n, sums in part} for part in rows]
    assert ids[0].keys() == ids[1].keys() == ids[2].keys() and len(ids[0]) > 100
    for key, sums in ids[0].items():
        assert ids[1][key] == pytest.approx(sums, rel=1e-5, abs=2e-3) and ids[2][key] == pytest.approx(sums, rel=1e-5, abs=2e-3)
    verdicts = language_id.identify(both, models[1])
    assert verdicts.count() == both.count()
    assert {(r.lang_pred, r.rejected) for r in verdicts.where("doc_id = -4 OR doc_id IS NULL").collect()} >= {("en", False)}
    # One text by the definition.
    texts = {}
    for row in training.collect():
        texts.setdefault(row.lang, []).append(row.text)
    alphabet = len({c for own in texts.values() for t in own for c in brute.characters(t)}) + 1
    plain = {lang: brute.CharacterModel(own, alphabet) for lang, own in texts.items()}
    own = "   " + brute.characters("zqxj éß жя ")
    grams = [own[i : i + 4] for i in range(len(own) - 3)]
    first = language_id.measured(make_docs({1: "zqxj éß жя "}), models[1]).first()
    assert first.sums == pytest.approx(
        [sum(math.log(plain[lang].chance(g)) for g in grams) for lang in models[1].langs], rel=1e-5
    )


def test_every_language_has_a_limit(spark):
    rows = [(f"abab baab abba {'ab' * (i % 7)}", "x") for i in range(3000)]
    rows += [("cdc ddc cdcd", "y"), *[("12 34", "z")] * 1000, ("efe fef", "z")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), calibration_texts=5)
    assert set(model.limits) == set(model.langs) == {"x", "y", "z"}


def test_limits_come_from_every_training_text(spark):
    """More texts than a sample held; their medians are those of all rows, and a single odd one counts."""
    draw = random.Random(3)
    rows = [("".join(draw.choice("abc ") for _ in range(draw.randint(1, 300))), "x") for _ in range(4500)]
    rows += [("".join(draw.choice("bcd ") for _ in range(draw.randint(150, 300))), "y") for _ in range(601)]
    rows += [("zzzz qqqq " * 10000, "y"), ("12 34", "y"), ("only one", "z"), ("56", "w")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(frame)
    found = language_id.measured(frame, model).where("n > 0").toArrow().to_pandas()
    own = [model.langs.index(lang) for lang in found["lang"]]
    for name in ("sums", "squares"):
        found[name] = [values[i] for values, i in zip(found[name], own, strict=True)] / found["n"]
    assert set(model.limits) == {"x", "y", "z"} and len(found) == 4500 + 602 + 1 - sum(not t.strip() for t, _ in rows)
    for lang, part in found.groupby("lang"):
        within = ((part["squares"] - part["sums"] ** 2).clip(lower=0) * part["n"]).sum() / part["n"].sum()
        long = -part[part["n"] >= min(200, part["n"].median())]["sums"]
        middle = long.median()
        spread = max(1.4826 * (long - middle).abs().median(), language_id.LEAST_SPREAD * middle)
        assert model.limits[lang] == pytest.approx((middle, spread, within), rel=1e-7)


def test_fitting_and_identifying_at_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000").select("doc_id", "text", "lang")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    columns = ("doc_id", "lang_pred", F.round("score", 6).alias("score"), "rejected")
    apart = language_id.identify(docs, language_id.fit(docs)).select(*columns)
    at_once = language_id.fit_and_identify(docs).select(*columns)
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, apart.collect())) and at_once.count() > 100


def test_without_training_rows(spark, make_docs):
    model = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert language_id.identify(make_docs({1: "some text"}), model).first().lang_pred == "und"


def test_quality_of_held_out_documents(spark, medium):
    found = llm_queries()["op2_quality_classifier"](spark, medium)
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert sum(r.quality == r.predicted for r in rows) >= 0.93 * len(rows)
    assert found.count() == spark.read.parquet(f"{medium}/documents.parquet").count()


def test_quality_without_labels(spark, make_docs):
    docs = make_docs({1: None, 2: "words"})
    empty = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, empty)).collect()
    assert [r.score for r in rows] == [0.5, 0.5]


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_leaks(spark, make_docs, tangled, block_words):
    passage = brute.words(tangled[30])[20:80]
    items = {
        1: " ".join(passage[5:45]),
        2: " ".join(passage[:30]).upper(),
        3: "one two three",
        4: "",
        5: None,
        6: " ".join([*passage[10:40], "changed", *passage[41:60]]),
        7: "nowhere " * 20,
        8: "the " * 12,
    }
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.leaks(make_docs(tangled), benchmark, block_words=block_words).collect()
    expected = brute.leaks(tangled, {i: t for i, t in items.items() if t})
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(expected)
    assert len(found) == len(expected) > 10


def test_items_without_an_id_are_reported(spark, make_docs, tangled):
    passage = " ".join(brute.words(tangled[30])[20:60])
    benchmark = spark.createDataFrame([(None, passage), (1, passage)], "item_id long, text string")
    found = decontamination.leaks(make_docs({30: tangled[30], 1: "one"}), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(30, None, 1.0), (30, 1, 1.0)}


def test_no_items_no_leaks(spark, make_docs, tangled):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(make_docs(tangled), benchmark).isEmpty()
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.leaks(make_docs({}), items).isEmpty()


def test_leaked_documents_of_the_test_tables(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    short = {d: t for d, t in docs.items() if t and len(t) < 3000}
    found = llm_queries()["op9_decontamination"](spark, small).where(F.col("doc_id").isin(list(short))).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(brute.leaks(short, items))
