"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import ann, byte_bpe, conversation_repair, exact_dedup, importance, line_dedup, lm_score, materialise, minhash, ngram_join, packing, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op8_materialise": materialise.op8_materialise,
    "op10_lm_score": lm_score.op10_lm_score,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op6_ann": ann.op6_ann,
    "op2_toxicity": toxicity.op2_toxicity,
    "op7_packing": packing.op7_packing,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_importance": importance.op11_importance,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_minhash": minhash.op13_minhash,
}

SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
