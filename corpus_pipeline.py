"""A corpus cleaned and tokenised in stages; each takes what the one before has kept.

A stage is written as Parquet before the next reads it, and what the next has read is deleted. All but the last return the columns
of documents: language ID drops texts without a recognised language, near-dedup keeps
one document of each group (five-word shingles, similarity 0.8), substring dedup cuts repeated passages out of texts (and drops
a document of which nothing is left), decontamination drops documents with benchmark
passages, and the last returns token ids.

Defined results: null, empty and letterless texts go in the first stage. Repeated rows (one id and text) are one document to
near-dedup and stay or go together; rows with a null id are kept by it. Columns besides
doc_id, text, lang, source and n_chars pass through all stages, but those named like a result of the last one, which it replaces. Without labelled
languages all goes; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontam, langid, minhash, substring
from evidentia.llm.storage import drop, written

MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts whose best language is not likelier than not."""
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return found.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group; five-word shingles, similarity 0.8."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that occur earlier; n_chars follows the text."""
    cut = substring.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of the ids and of what they decode to, and ids."""
    return bpe.encode(docs.drop("n_chars"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL expresses neither the language model nor the merges; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
