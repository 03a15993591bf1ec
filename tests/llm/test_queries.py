"""The registered queries against SQL, and the pipeline against a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle.compare import differences, open_tables
from tests.llm import brute
from tests.llm.test_dedup import _repeated_ids
from wardlight.llm import decontamination, language_id, packing, quality_rules
from wardlight.llm.common import held_out
from wardlight.llm.oracle import llm_oracle
from wardlight.llm.queries import llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_same_rows_as_sql(spark, small, name):
    assert differences(llm_queries()[name](spark, small), open_tables(small), llm_oracle()[name]) == []


def test_every_operator_is_registered():
    import __spark_entry__ as entry_points

    names = entry_points.queries()
    assert set(llm_queries()) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_chat"])
def test_native_plans_run_no_python(spark, small, name):
    plan = llm_queries()[name](spark, small)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, small):
    """Plain stages over the documents that the language model keeps."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    fine = {r.doc_id for r in language_id.identify(docs, model).where("NOT rejected").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in fine}
    assert len(texts) >= 0.99 * docs.count()
    texts = {d: texts[d] for d, (_, first) in brute.near_duplicates(texts, percent=corpus_pipeline.NEAR_PERCENT).items() if d == first}
    cut = brute.without_repeated_words(texts)
    texts = {d: cut[d][2] if cut[d][1] else t for d, t in texts.items() if not cut[d][1] or cut[d][1] < cut[d][0]}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    wanted = {s for t in items.values() for s in brute.shingles(t)}
    near = {d: t for d, t in texts.items() if wanted & set(brute.shingles(t))}
    for d, _ in brute.leaks(near, items, decontamination.LEAST_SIMILARITY):
        texts.pop(d, None)
    encoder = packing.Encoder(packing.tokenizer_path())
    expected = {
        (d, k, at, n)
        for d, t in texts.items()
        for k, (at, n) in enumerate(packing.cut_points(len(encoder.encode([t or ""])[0]) // 4 + 1, 1024))
    }
    rows = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in rows} == expected and len(rows) == len(expected)


def test_near_duplicates_of_the_pipeline(spark, make_docs, small):
    """Copies of a similarity from 0.80 on go, others stay."""
    texts = {}
    for i in range(30):
        base = [f"w{i}x{j}" for j in range(204)]
        changed = [f"{w}!" if j in (20, 60, 100, 140) else w for j, w in enumerate(base)]
        apart = [f"{w}?" if j in (15, 50, 85, 120, 155) else w for j, w in enumerate(base)]
        texts |= {3 * i: " ".join(base), 3 * i + 1: " ".join(changed), 3 * i + 2: " ".join(apart)}
    expected = {d for d, (_, first) in brute.near_duplicates(texts, percent=80).items() if d == first}
    assert expected == set(texts) - {3 * i + 1 for i in range(30)}
    stage = dict(corpus_pipeline.STAGES)["minhash"]
    assert {r.doc_id for r in stage(spark, make_docs(texts), small).collect()} == expected


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, make_docs, tangled, small):
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 200").first()["text"]
    docs = make_docs([(500, item), (500, "some clean text"), (None, item), (None, "more clean text")])
    left = {(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, small).collect()}
    assert left == {(500, "some clean text"), (None, "more clean text")}
    docs = make_docs([*tangled.items(), (500, "12 34"), (500, tangled[40]), (None, "12 34")])
    left = {(r.doc_id, r.text) for r in stages["language_id"](spark, docs, small).collect()}
    assert (500, tangled[40]) in left and not {(500, "12 34"), (None, "12 34")} & left


def test_texts_that_share_an_id_keep_their_own_text(spark, make_docs, small):
    """Whether the other text of an id is short or long, and as near duplicates."""
    stages = dict(corpus_pipeline.STAGES)
    for short in (True, False):
        rows = _repeated_ids(short)
        left = [(r.doc_id, r.text) for r in stages["substring_dedup"](spark, make_docs(rows), small).collect()]
        assert sorted(left, key=str) == sorted(
            [rows[0], (2, "alpha beta"), rows[2], (3, "x"), (3, "x"), (3, None), rows[6]], key=str
        )
        left = [(r.doc_id, r.text) for r in stages["minhash"](spark, make_docs(rows), small).collect()]
        assert sorted(left, key=str) == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)


def test_stages_keep_columns_and_rows_of_any_kind(spark, make_docs, tangled, small):
    clashing = ("key", "n_words", "kept_text", "component_id", "rejected", "item_id", "length", "row")
    rows = [*tangled.items(), (7, tangled[7]), (None, "some words of no document")]
    docs = make_docs(rows).withColumns({name: F.lit("own") for name in clashing})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small)
        assert found.columns == docs.columns, name
        assert found.where("doc_id = 7").count() == 2, name
        assert found.where("doc_id IS NULL AND key = 'own'").count() == 1, name
        assert stage(spark, docs.limit(0), small).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= len(rows)
    counted = quality_rules.counts(docs)
    assert counted.where("doc_id = 3 AND n_words = 1").count() == 1


def test_pipeline_limits_count_every_training_text(spark, small, monkeypatch):
    seen, limits = [], language_id._limits

    def counted(found, langs):
        seen.append(found.where("lang IS NOT NULL").count())
        return limits(found, langs)

    monkeypatch.setattr(language_id, "_limits", counted)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    corpus_pipeline.identify_language(spark, docs, small)
    training = docs.where(~held_out(F.col("doc_id"))).where("text IS NOT NULL AND lang IS NOT NULL")
    assert seen == [training.count()]
