"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, licenses, merkle, mixing, packing, prefix_trie, quality, runs, simhash, token_counts, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_licenses": licenses.op2_licenses,
    "op3_merkle": merkle.op3_merkle,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_chat": chat.op6_chat,
    "op7_topk": topk.op7_topk,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_runs": runs.op13_runs,
}
SQL = {
    "op2_licenses": licenses.OP2_SQL,
    "op3_merkle": merkle.OP3_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_runs": runs.OP13_SQL,
}
