"""Quality rules, exact and near deduplication, mixing and encoding of a corpus, as one pipeline.

Each stage takes the documents that its predecessor kept and gives back the columns of documents; the last gives the
counts and digests of each document's token ids and of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from quernel.llm.common import checkpoint, table

#: Lanes of the near-dedup stage's fingerprints.
LANES = 3


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words and a similarity of 0.8 link: the one with the smallest id."""
    return simhash.one_of_each(docs, width=5, similarity=0.8, lanes=LANES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and decoded_chars of each document of the mix."""
    return bpe.round_trip(docs)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: The near-dedup and encoding stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each stage's result is cut off from its lineage, so that none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
