"""The registered queries of the operators: each applies its operator to a whole table."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import (
    chat,
    decontamination,
    infilling,
    language_id,
    merkle,
    minhash,
    packing,
    piece_encoding,
    quality_classifier,
    quality_rules,
    recompression,
    suffix_dedup,
    warc,
)
from wardlight.llm.common import held_out, new_folder, read_table, stored


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # The base condition comes first, so texts it fails skip the cascade.
    rules = [
        quality_rules.Rule(r.name, ~base_failed & r.rejects, r.units, r.unit_cost)
        for r in quality_rules.standard_rules()
    ]
    return quality_rules.cascade(docs, rules, prepare=quality_rules.counts).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.col("failed_rule").isNull()).alias("kept"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from three quarters of the labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_classifier.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return quality_classifier.score(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that occur earlier."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, with_bytes=False).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    folder = new_folder(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_archive(spark, folder))


#: Both rows of the conversation that the contract adds.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted text."""
    given = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    messages = stored(chat.threads(given.unionByName(added)), "chat-messages")
    formatted = stored(chat.format_paths(messages), "chat-formatted")
    back = formatted.select("tree_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""
    )
    trained = chat.trained_text(F.col("turns"), F.col("loss_spans"))
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(F.encode(trained, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    known = F.when(~held_out(F.col("doc_id")), F.col("lang"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", known.alias("lang"))
    found = language_id.fit_and_identify(docs)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    found = minhash.groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_shingles",
        F.col("component_id").cast("long").alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that earlier documents hold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompression.remove_repeats(docs, with_text=False).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return packing.pack(docs)


def _sha256(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the sentencepiece model, and decoded again."""
    encoded = piece_encoding.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return piece_encoding.decode(encoded).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(listed).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in the middle, and rebuilt from what was written."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return infilling.restore(infilling.transform(docs)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        _sha256(F.col("output")).alias("output_sha256"),
        _sha256(F.col("restored")).alias("restored_sha256"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; a fifth of the documents are tampered with before they are verified."""
    columns = list(merkle.LEAF_COLUMNS)
    docs = read_table(spark, sf_dir, "documents").select(*columns)
    lowered = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = docs.withColumn("changed_leaf", F.when(tampered, merkle.leaf_digest({"text": lowered})))
    proven = merkle.proofs(merkle.build(docs, carried=("changed_leaf",)))
    return proven.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def llm_queries():
    """The queries by name."""
    found = (
        op1_quality_rules,
        op2_quality_classifier,
        op3_suffix_dedup,
        op4_warc,
        op5_chat,
        op6_language_id,
        op7_minhash,
        op8_recompression,
        op9_decontamination,
        op10_packing,
        op11_piece_encoding,
        op12_infilling,
        op13_merkle,
    )
    return {query.__name__: query for query in found}
