"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import align, audit, bpe, chat, decontam, embeddings, langid, minhash, oracles, quality, rules, substring, tokenstore, warc
from evidentia.llm.storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.train(docs.where(fold != 1), public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered(_table(spark, sf_dir, "conversations"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenstore.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)
    return tokenstore.checksums(tokenstore.placed_tokens(spark, path))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and of the longest verbatim matches how many there are, the longest's words and where the first such begins."""
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontam.contamination(docs, items, with_text=False, with_matches=True)
    best = F.array_max(F.transform("matches", lambda m: F.struct(m.n_words.alias("words"), (-m.doc_start).alias("at"))))
    return found.select(
        *[c for c in found.columns if c != "matches"],
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(best.words, F.lit(0).cast("long")).alias("longest_match"),
        (-best.at).alias("longest_start"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def oracle_sql() -> dict:
    return {
        "op1_warc_revisits": oracles.WARC,
        "op2_minhash_near_dedup": oracles.MINHASH,
        "op4_substring_dedup": oracles.SUBSTRING,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op9_embedding_near_dedup": oracles.EMBEDDINGS,
        "op12_filter_audit": oracles.AUDIT,
    }


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_warc_revisits, op2_minhash_near_dedup, op3_language_id, op4_substring_dedup, op5_chat_format, op6_token_store,
            op7_decontamination, op8_byte_bpe, op9_embedding_near_dedup, op10_quality, op11_token_alignment, op12_filter_audit, op13_quality_rules
        )
    }
