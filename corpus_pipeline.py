"""The corpus pipeline: quality rules, SimHash near-duplicates, pseudonyms, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Its result is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; nulls, empty texts, repeated rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealweave.llm import mixing, pii, piece, quality, simhash
from dealweave.llm.common import read_table, written
from dealweave.llm.queries import piece_model_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms."""
    return pii.pseudonymise(docs, pii.session_key(spark)).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are drawn."""
    return mixing.mix(docs).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, with digests of the ids and of the decoded text."""
    return piece.digests(docs, piece_model_path())


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{number}")
    return docs


#: Keyed permutations, hypergeometric draws and piece merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
