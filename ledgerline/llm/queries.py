"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_mtree, op2_ctw, op3_bpe, op4_toxicity, op5_mixing, op6_parity_join, op7_warc, op8_extract, op9_sharding, op10_quality, op11_substrings, op12_runs, op13_repair
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_search": lambda spark, d: op1_mtree.query(table(spark, d, "embeddings")),
    "op2_ctw_scores": lambda spark, d: op2_ctw.query(table(spark, d, "documents")),
    "op3_byte_bpe": lambda spark, d: op3_bpe.query(table(spark, d, "documents")),
    "op4_toxicity_chain": op4_toxicity.query,
    "op5_source_mixing": lambda spark, d: op5_mixing.query(table(spark, d, "documents")),
    "op6_parity_join": lambda spark, d: op6_parity_join.query(table(spark, d, "documents")),
    "op7_warc_reassembly": lambda spark, d: op7_warc.query(table(spark, d, "pages")),
    "op8_wrapper_extraction": lambda spark, d: op8_extract.query(table(spark, d, "pages")),
    "op9_compaction": lambda spark, d: op9_sharding.query(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: op10_quality.query(table(spark, d, "documents")),
    "op11_repeated_passages": lambda spark, d: op11_substrings.query(table(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: op12_runs.query(table(spark, d, "documents")),
    "op13_conversation_repair": lambda spark, d: op13_repair.query(table(spark, d, "conversations")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_mtree_search": op1_mtree.SQL,
    "op6_parity_join": op6_parity_join.SQL,
    "op7_warc_reassembly": op7_warc.SQL,
    "op9_compaction": op9_sharding.SQL,
    "op10_quality_rules": op10_quality.SQL,
    "op11_repeated_passages": op11_substrings.SQL,
    "op12_periodic_runs": op12_runs.SQL,
    "op13_conversation_repair": op13_repair.SQL,
}
