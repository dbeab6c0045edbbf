"""Registry of the training-data queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import (
    align,
    bpe,
    chat_format,
    decontaminate,
    near_dedup,
    prefix_trie,
    quality,
    secrets,
    sharding,
    suffix_dedup,
    token_files,
    topk,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    fns = [secrets.op1_secret_scans, topk.op2_exact_top_k, suffix_dedup.op3_suffix_array_dedup, toxicity.op4_toxicity,
           sharding.op5_sharding, quality.op6_quality_classifier,
           decontaminate.op7_benchmark_decontamination,
           bpe.op8_byte_bpe, chat_format.op9_chat_formatting, near_dedup.op10_minhash_near_dedup,
           align.op11_tokenizer_alignment, prefix_trie.op12_prefix_trie, token_files.op13_token_id_output]
    return {f.__name__: f for f in fns} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": secrets.ORACLE, "op2_exact_top_k": topk.ORACLE,
            "op7_benchmark_decontamination": decontaminate.ORACLE, "op9_chat_formatting": chat_format.ORACLE,
            "op10_minhash_near_dedup": near_dedup.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
