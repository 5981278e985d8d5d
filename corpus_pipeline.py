"""Corpus preparation in five stages; each reads what its predecessor kept.

``run`` applies them to ``documents``; every stage's result is written as Parquet in the shared
folder and read again, so a lost executor costs a stage at most.  SQL cannot express a trained
classifier, shingle classes or token packing, so there is no ORACLE_SQL: tests/llm holds the
stages against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import exact_dedup, jaccard, packing, secret_scan, toxicity
from maskwell.llm.common import materialize, prepare, table, without

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM stay; the model learns from all labelled rows."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, model)
    kept = scored.filter(F.col("score") < TOXIC_FROM).drop("score")
    return kept.withColumnRenamed("__score", "score") if "score" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    prepare(spark)
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class linked by five-word shingles and a similarity of 0.8 stays."""
    prepare(spark)
    linked = jaccard.link(docs, jaccard.WORDS, jaccard.PERCENT)
    verdicts = linked.select("doc_id", F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False)).alias("gone"))
    return without(docs, ["doc_id"], materialize(spark, verdicts)).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in the text; n_chars follows it."""
    prepare(spark)
    masked = secret_scan.redact(docs, secret_scan.train(secret_scan.default_samples(spark)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in the sequences, as training reads them."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(spark, docs)
    return docs
