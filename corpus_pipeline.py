"""The corpus pipeline: quality classifier, line dedup, near duplicates, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A stage is written as Parquet below the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.llm import byte_bpe, jaccard_join, line_dedup, mixing, rule_ensemble
from layerweave.session import scratch_path

TOKENIZER = "byte_bpe_50k.tiktoken"


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where a stage may have changed it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good ones; the others go."""
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.accepted(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier place holds already; all documents stay."""
    return _with_length(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, Jaccard 0.8)."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated per epoch, dropped beyond the budget of their source."""
    return _with_length(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document that is left."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: A fitted classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
