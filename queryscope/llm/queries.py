"""The registered queries of this package: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscope.llm import ann, decontam, kneser_ney, langid, license_scan, mixing, quality, records, simhash, warc


def tokenizer_path() -> str:
    """Where this machine keeps the default tokenizer; the path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id, folds: int, fold: int):
    """Column: crc32(doc_id as text) mod ``folds`` is ``fold``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return records.read_records(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), tau=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=5)
    return quality.classify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~in_fold(F.col("doc_id"), 4, 2)))
    return langid.identify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs.where(~in_fold(F.col("doc_id"), 7, 2)))
    return kneser_ney.score(docs, model).withColumn("held_out", in_fold(F.col("doc_id"), 7, 2))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("target_uri")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_multi_index_hashing, op2_token_records, op3_simhash, op4_quality, op5_language_id, op6_kneser_ney, op7_warc, op8_winnowing, op9_mixing, op10_license_scan)
    return {f.__name__: f for f in every}
