"""A training corpus from ``documents``: five stages, each written as Parquet and read
again as the next one's documents.

Every stage works on all that the one before it kept.  All but the last return the
columns of ``documents``; the last returns the token ids of each text of the mix.

Defined results: null and empty texts are one group of equal texts, whose first row stays
until the mix, which takes only texts with words; rows without doc_id link with nothing and
stay until then; of equal texts the longest row, then the smallest doc_id stays, of near
copies the smallest doc_id; rows of one doc_id with different texts are kept apart; the mix
repeats a document at most three times; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsqlspark.llm import exact, jaccard, mixing, pieces, toxicity
from tsqlspark.llm._common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of equal texts stays."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the smallest document of each component of near copies stays; five-word
    shingles and a similarity of 0.8, the values for near duplicates."""
    return jaccard.keep_first(docs, percent=80, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: whole documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: doc_id, ids and scores of the best segmentations, round_trip, ids of the others."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: Compression lengths and tokens cannot be had in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
