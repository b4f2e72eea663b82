"""A training corpus from raw documents: each stage is one operator of ``barloom.llm``.

Nulls, repeated rows and empty tables pass through every stage as the operators define them;
columns beyond those of ``documents`` are not carried.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, jaccard, langid, pii
from barloom.plans.storage import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the votes a text counts as no language at all.
LEAST_SCORE = 0.3
#: Pre-tokens a worker keeps: it shares the executor with what earlier stages left.
KEPT = 80_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; ``lang`` becomes the prediction."""
    learn = F.col("doc_id").isNotNull() & ~langid.held_out()
    found = langid.predict(docs, langid.fit(docs, learn), COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of copies and near copies one document stays."""
    return jaccard.one_of_each(docs, COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.matches(docs, benchmark, COLUMNS).where(F.size("hits") == 0).drop("hits")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are masked in the text."""
    out = pii.sanitise(docs, COLUMNS)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    import public_tokenizers
    out = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                     ["doc_id", "lang", "source", "n_chars"], kept=KEPT)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]
#: The stages are classifiers, joins and merges that SQL can't express; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
