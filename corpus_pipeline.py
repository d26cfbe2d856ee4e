"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return rows with the columns of ``documents``. A table without rows passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queryscope.llm import decontam, mixing, quality, records, simhash
from queryscope.llm.common import stored
from queryscope.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents outside the held-out fold."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), held_out=5))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash or MinHash bands bring together and the texts confirm, the one with the smallest doc_id stays.

    Texts without words are copies of one another.
    """
    return simhash.dedup(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of sources takes them."""
    return mixing.emit(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary records of all documents and copies, read back: doc_id, start, n_tokens, ids_crc32, shard, offset."""
    return records.read_records(records.write_records(docs, tokenizer_path(), end_id=1), with_ids=False).drop("ids")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", not_leaked), ("mixing", mixed), ("token_records", token_records)]

#: Trained models, hashed components and a tokenizer have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
