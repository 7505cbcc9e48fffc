"""Training-corpus pipeline: toxicity, exact dedup, near dedup, passage dedup, packing.

Every stage works on all that the stage before it kept; ``run`` writes each result as
Parquet in the shared folder and rereads it. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from marketlens.llm.common import materialize, read, workers_find_package
from marketlens.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    workers_find_package(spark)
    scored = toxicity.score_texts(docs, toxicity_model(spark, sf_dir), out="__toxic")
    return scored.where(F.col("__toxic") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    workers_find_package(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the least id."""
    workers_find_package(spark)
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; n_chars follows the text."""
    workers_find_package(spark)
    out = substring_dedup.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in the packed sequences."""
    workers_find_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]

ORACLE_SQL = None  # classifier, fingerprints and packing are beyond SQL: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
