"""The queries of this package by name, with SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dominance, licenses, neighbours, packing, repeats, secrets, set_join, sharding, token_align, token_count, topk, toxicity
from .textkit import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_toxicity": lambda spark, d: toxicity.classify(documents(spark, d), table(spark, d, "labels")),
        "op2_secret_scan": lambda spark, d: secrets.scan(documents(spark, d)),
        "op3_histogram_shards": lambda spark, d: sharding.shard_documents(documents(spark, d)),
        "op4_length_packing": lambda spark, d: packing.pack_documents(documents(spark, d)),
        "op5_bm25_decontamination": lambda spark, d: decontaminate.find(documents(spark, d), table(spark, d, "benchmark")),
        "op6_seed_extend_dedup": lambda spark, d: repeats.remove(documents(spark, d)),
        "op7_skip_jaccard_join": lambda spark, d: set_join.join(documents(spark, d)),
        "op8_license_scan": lambda spark, d: licenses.scan(documents(spark, d)),
        "op9_token_counts": lambda spark, d: token_count.count_tokens(documents(spark, d)),
        "op10_additive_neighbours": lambda spark, d: neighbours.search(table(spark, d, "embeddings")),
        "op11_token_alignment": lambda spark, d: token_align.align(documents(spark, d)),
        "op12_dominance_counts": lambda spark, d: dominance.count_sales(table(spark, d, "sales")),
        "op13_norm_bucket_topk": lambda spark, d: topk.search(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_length_packing": packing.ORACLE, "op6_seed_extend_dedup": repeats.ORACLE, "op7_skip_jaccard_join": set_join.ORACLE, "op12_dominance_counts": dominance.ORACLE, "op13_norm_bucket_topk": topk.ORACLE}
