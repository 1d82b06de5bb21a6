"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialplate.llm import language_id, line_dedup, ngram_join, packing, pii
from spatialplate.llm.common import written

#: The surrogates' key; without one in the environment it is drawn anew for each process, so that nobody can know it.
KEY = os.environ.get("SURROGATE_KEY", "").encode() or secrets.token_bytes(32)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that are `und` (no text, or no letter) go."""
    return language_id.identify(docs, language_id.fit(docs)).where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return _counted(line_dedup.drop_boilerplate(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, once; documents without an id stay, and so do different texts of one id."""
    gone = ngram_join.cluster(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(written(gone, "duplicates").hint("merge"), "doc_id", "left_anti")
    # The join has put equal ids together, so that repeated rows are found where they are.
    n = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("doc_id"))
    return kept.withColumn("_n", n).where(F.col("_n") == 1).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _counted(pii.replace(docs, KEY).select(*docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("languages", languages), ("lines", lines), ("near_duplicates", near_duplicates), ("surrogates", surrogates), ("sequences", sequences)]

#: Cross-parsing, keyed hashes and byte pairs are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
