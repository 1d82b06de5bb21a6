"""The queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fill_middle, language_id, line_dedup, multi_index, ngram_join, packing, pii, ranked_search, secret_scan, token_rollup, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the registered query; a real one comes from the caller.
KEY = b"a key for tests"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", F.col("_entities").cast("long").alias("n_entities"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rate").alias("rate"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(spark, table(spark, sf_dir, "documents"), token_rollup.fresh_path(spark)).totals()


def op7_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows.where(F.col("vec_id") % 100 == 0), rows, 10)


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transformed(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op13_heavy_split_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.marked(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_merge_replay": op3_merge_replay,
    "op4_secret_scan": op4_secret_scan,
    "op5_cross_parsing": op5_cross_parsing,
    "op6_token_rollup": op6_token_rollup,
    "op7_heavy_light_join": op7_heavy_light_join,
    "op8_site_lines": op8_site_lines,
    "op9_exact_topk": op9_exact_topk,
    "op10_multi_index": op10_multi_index,
    "op11_block_max_search": op11_block_max_search,
    "op12_fill_middle": op12_fill_middle,
    "op13_heavy_split_dedup": op13_heavy_split_dedup,
}

SQL: dict[str, str] = {
    "op6_token_rollup": token_rollup.SQL,
    "op8_site_lines": line_dedup.SQL,
    "op9_exact_topk": topk.SQL,
    "op11_block_max_search": ranked_search.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_heavy_split_dedup": exact_dedup.SQL,
}
