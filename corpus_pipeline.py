"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept, stored as Parquet, and
returns the documents it keeps with all their columns; the last one returns the
packed pieces.

Every row is judged by its own text, also where texts share an id. Near duplicates and passages are
found in the order of the ids; of equal ids with different texts, in that of the texts' digests. Rows that
repeat id and text stay or go together. Rows without an id have no place in that order: as near duplicates they
stay and they lose no passage, but they go for their language or a benchmark item like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import decontamination, language_id, minhash, packing, recompression
from wardlight.llm.common import held_out, read_table, released, stored, told_apart


#: Similarity from which documents are near duplicates, and bands that find such pairs.
NEAR_PERCENT, NEAR_BANDS, NEAR_BAND_SLOTS = 80, 40, 5
#: The name under which ids are joined, apart from any column of the documents.
_ID = "__pipeline_id"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of their id and text."""
    key = F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn(_ID, F.sha2(key, 256))


def _without(docs: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The documents whose key is not among those gone.

    What is gone is stored first: Spark then knows its size, and shuffles the
    documents with their texts only if it is large.
    """
    listed = stored(gone.select(F.col(column).alias("__pipeline_gone")).distinct(), "pipeline-gone")
    return docs.join(listed, docs[column] == listed["__pipeline_gone"], "left_anti")


def _without_texts(docs: DataFrame, found, *more: Column) -> DataFrame:
    """The documents whose own text is not among the rows that `found` returns of (doc_id, text, ...)."""
    keyed = _keyed(docs)
    gone = found(keyed.select(F.col(_ID).alias("doc_id"), "text", *more)).select(F.col("doc_id").alias(_ID))
    return _without(keyed, _ID, gone).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; `lang` stays as it came."""
    known = F.when(~held_out(F.col("doc_id")), F.col("lang")).alias("lang")
    return _without_texts(docs, lambda texts: language_id.fit_and_identify(texts).where("rejected"), known)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    numbered, _ = told_apart(docs, _ID)
    groups = minhash.groups(numbered.select(F.col(_ID).alias("doc_id"), "text"), NEAR_PERCENT, NEAR_BANDS, NEAR_BAND_SLOTS)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(_ID))
    return _without(numbered, _ID, gone).select(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; texts that lose nothing stay as they are.

    A document that loses every word goes, and `n_chars` follows the text.
    """
    numbered, _ = told_apart(docs, _ID)
    left = stored(
        recompression.remove_repeats(numbered.select(F.col(_ID).alias("doc_id"), "text"))
        .where("n_removed > 0")
        .select(
            F.col("doc_id").alias("__pipeline_cut"),
            F.col("kept_text").alias("__pipeline_text"),
            (F.col("n_removed") == F.col("n_words")).alias("__pipeline_empty"),
        )
        .dropDuplicates(["__pipeline_cut"]),
        "pipeline-cut",
    )
    text = F.when(F.col("__pipeline_cut").isNotNull(), F.col("__pipeline_text")).otherwise(numbered["text"])
    new = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return (
        numbered.join(left, numbered[_ID] == left["__pipeline_cut"], "left")
        .where("__pipeline_empty IS NULL OR NOT __pipeline_empty")
        .select(*[new.get(name, numbered[name]) for name in docs.columns])
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return _without_texts(docs, lambda texts: decontamination.leaks(texts, benchmark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, packed into sequences."""
    return packing.pack(docs.withColumn("doc_id", F.col("doc_id").cast("long")))


STAGES = [
    ("language_id", identify_language),
    ("minhash", drop_near_duplicates),
    ("substring_dedup", remove_passages),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Language models and tokenization have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
