"""The queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licenses, mixing, pii, quality, repair, simhash, tokenfile, tokens, toxicity, whitening
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and whether they exceed a context of 1024."""
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ids to files with seek tables and reads the files back."""
    manifest = tokenfile.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)
    return tokenfile.read_token_files(manifest)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its edit distance and place."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2, blocks=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, and templates that a line of it contains."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all conversations with their results, topological levels, problems and canonical records."""
    calls, results = chat.conversation_calls(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, chat.SCHEMAS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, its nearest examples, and whether its label was held out."""
    rows = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data of every document."""
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, rules and the model's verdict for every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that mend it."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every finite vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 8)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources by weights 5, 2 and 1 takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_bpe_round_trip, op3_license_scan, op4_chat_formatting, op5_toxicity, op6_personal_data, op7_decontamination, op8_token_files, op9_simhash, op10_quality, op11_conversation_repair, op12_embedding_whitening, op13_source_mixing)
}
ORACLE_SQL = {"op3_license_scan": licenses.oracle(), "op4_chat_formatting": chat.ORACLE}
