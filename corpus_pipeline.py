"""From raw documents to training sequences: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of documents. Null and empty
texts fail the quality rules, so none gets further; rows that repeat stay or go together, except that near-duplicates leave one id of
each group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import bbit_minhash, concat_pack, gru_toxicity, secret_owners, suffix_quality
from lodeframe.llm.queries import bpe_file
from lodeframe.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the limits on repetition reject go."""
    return suffix_quality.drop_repetitive(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the labels of documents whose crc32(doc_id) mod 5 is 0 are never used."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return gru_toxicity.drop_toxic(docs, gru_toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five words, similarity 0.8 or more) the document with the least id stays."""
    return bbit_minhash.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that belong to few owners and look alive are replaced in the texts; widely copied examples stay, and so do all documents."""
    return secret_owners.redact(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return concat_pack.pack(docs, bpe_file())


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: A trained network and minima over hashes decide here, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each keeps is written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
