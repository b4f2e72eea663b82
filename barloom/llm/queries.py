"""The registered query of every operator, and its SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (bpe, decontam, jaccard, langid, order, pii, quality, runs, spelling,
                         suffix, urls, vectors, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed",
                      F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.byte_shards(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digests(_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).drop("pattern")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_training_order": op4_training_order,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_runs": op11_runs,
    "op12_spelling": op12_spelling,
    "op13_vectors": op13_vectors,
}
STATEMENTS = {"op1_warc": warc.SQL, "op8_quality": quality.SQL, "op10_url_filter": urls.SQL,
              "op13_vectors": vectors.SQL}
