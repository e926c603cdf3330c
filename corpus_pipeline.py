"""The corpus pipeline: toxicity, quality rules, near-dedup, packing.

Each stage takes all that the stage before it kept.  Stages but the last return
the columns of `documents`; the last returns the packed pieces with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plexmill.llm import minhash, packing, quality, toxicity
from plexmill.llm.storage import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go; see `toxicity.drop_toxic` for nulls, long texts and repeated rows."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a rule go; see `quality.keep_good` for nulls, long texts and repeated rows."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; one row of each group stays.

    A row with a null doc_id or without a word is in no group and stays, a long text counts whole, of equal rows one
    stays, an empty table stays empty; see `minhash.keep_one_of_each_group`.
    """
    return minhash.keep_one_of_each_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows; a null or empty text has its end id alone, a null doc_id stays null, rows that repeat
    are packed as often as they occur, an empty table gives no piece, other columns are left out."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Neighbours, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
