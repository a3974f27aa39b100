"""From raw documents to token ids: language ID, exact and near deduplication, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, further ones included.

Stages decide about rows, not ids: a row with a null id, or with an id that other rows have too, stays or goes by its own
text, and rows equal in id and text share their fate. A null text is empty. Null and empty texts have no letters and leave
at the first stage; given to a later one, they pass near deduplication and decontamination, are equal to each other in
exact deduplication, and have no tokens. Texts of any length are read whole. Ties go to the largest id (exact) or the
smallest (near). An empty table gives an empty table. Tables that a stage writes on its way are deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casehours.llm import bpe, chosen_path, decontaminate, exact_dedup, langid
from casehours.llm.common import prepare, settled, table
from casehours.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without letters, and texts that fit no learned language, go."""
    prepare(spark)
    return langid.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id."""
    prepare(spark)
    return chosen_path.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, re-parameterised ones included."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document left."""
    prepare(spark)
    return bpe.round_trip_digests(docs, tokenizer_file(spark, "word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: Similarity joins and BPE are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
