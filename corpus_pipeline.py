"""The corpus pipeline: quality rules, toxicity, SimHash near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`.

Defined results: null and empty texts are rejected by the quality rules, so no later stage meets them in run(); each stage
also takes them on its own, as its operator's docstring says, and so very long texts, repeated rows and empty tables. Rows
equal in doc_id and text become one in near_duplicates. Further columns of a table go through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import packing, quality_rules, simhash, suffix_dedup, toxicity_cnn
from tessella.llm.common import labelled_sample, new_folder, table


DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage: Callable) -> Callable:
    """Columns beyond those of `documents` go through a stage under names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[c if c in DOCUMENTS else f"extra_{i}" for i, c in enumerate(names)]), sf_dir).toDF(*names)

    return run


@_own_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, less the lines that fail; n_chars follows the text."""
    found = quality_rules.evaluate(docs, tuple(docs.columns), cleaned="cleaned").where("kept")
    return found.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_own_names
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, finds clean."""
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, toxicity_cnn.MAX_PER_CLASS)
    return toxicity_cnn.score(docs, toxicity_cnn.train(sample), tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


@_own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their sets of five-word shingles."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


@_own_names
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less every byte under a repeated string of 200 bytes; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = suffix_dedup.as_text(suffix_dedup.remove_repeats(docs, rest))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: Trained scores, components and packing are not for SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
