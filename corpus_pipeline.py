"""A corpus pipeline of four operators: rejects toxic documents, keeps one of each group of near duplicates,
mixes the sources to their target weights, and encodes and decodes what the mix takes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listforge.llm import bpe, mixing, ngram_join, toxicity
from listforge.llm.common import save, table
from listforge.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5."""
    ship(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8."""
    ship(spark)
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, the last time cut to the blocks that its seeded sample takes."""
    ship(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    ship(spark)
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [("toxicity", reject_toxic), ("ngram_join", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: The similarity join and the fitted classifier have no equivalent in SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return docs
