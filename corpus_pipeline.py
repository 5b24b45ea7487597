"""Corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, redaction of personal data, encoding.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with all columns of its input and whatever rows
repeat; the last gives token ids. Results are written as Parquet in the shared folder and read again by the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm import bpe, decontam, pii, simhash, toxicity
from tripleloom.llm.common import new_folder, table

TOKENIZER = "word_bpe_49k.json"


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more (op 5). Examples come from the labelled documents of the stage's input."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more (op 9 and an exact join)."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget (op 7)."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind (op 6) and sets n_chars anew; null texts stay null."""
    return pii.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left (op 2): doc_id, token_ids, n_tokens. Null texts have no ids; repeated rows stay."""
    return bpe.encode_table(docs, public_tokenizers.path(TOKENIZER), ["doc_id"])


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", redaction),
    ("bpe_encoding", encoding),
]
#: SQL has neither nearest examples nor bit-parallel edit distance nor merges; tests hold the near-duplicate stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
