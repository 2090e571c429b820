"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, embedding_dedup, line_dedup, packing, quality, sharding, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_simhash": simhash.op6_simhash,
    "op7_bpe": bpe.op7_bpe,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
SQL = {"op5_quality_rules": quality.SQL, "op8_substring_dedup": substring_dedup.SQL, "op9_warc": warc.SQL, "op10_line_dedup": line_dedup.SQL}
