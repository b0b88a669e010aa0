"""The queries of this subpackage and their SQL, as `__spark_entry__` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality_rules

    return quality_rules.evaluate(table(spark, sf_dir, "documents"))


def op2_unigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import unigram_count

    return unigram_count.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import subword_classifier as sub

    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, sub.MAX_PER_CLASS)
    return _held_out(sub.score(docs, sub.train(sample)), 5, 0)


def _held_out(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % modulus == remainder
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import suffix_dedup

    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import warc_zip

    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import media_chunks

    return media_chunks.round_trip(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity_cnn as cnn

    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, cnn.MAX_PER_CLASS)
    return _held_out(cnn.score(docs, cnn.train(sample)), 4, 2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    found = (
        op1_quality_rules, op2_unigram_tokens, op3_quality_classifier, op4_bpe_round_trip, op5_simhash, op6_suffix_dedup,
        op7_warc_zip, op8_media_chunks, op9_toxicity, op10_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from tessella.llm import quality_rules, warc_zip

    return {"op1_quality_rules": quality_rules.ORACLE, "op7_warc_zip": warc_zip.ORACLE}
