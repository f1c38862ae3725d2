"""Registry of the subpackage: one query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from lurewatch.llm import bpe, conversations, gam, licenses, line_dedup, merkle, mixing, near_dup, pii, quality_rules, sharding, token_files, topk

QUERIES = {
    "op1_quality": gam.op1_quality,
    "op2_token_files": token_files.op2_token_files,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_topk": topk.op8_topk,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_licenses": licenses.op10_licenses,
    "op11_sharding": sharding.op11_sharding,
    "op12_conversations": conversations.op12_conversations,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE = {
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_sharding": sharding.ORACLE_SQL,
    "op12_conversations": conversations.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
