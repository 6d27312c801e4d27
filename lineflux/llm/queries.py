"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from . import alignment, bwt, decontaminate, hnsw, minhash, mixing, pii, quality, suffix_tree, timestamps, tokens, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_suffix_trees": suffix_tree.op5_suffix_trees,
    "op6_mix": mixing.op6_mix,
    "op7_near_embeddings": hnsw.op7_near_embeddings,
    "op8_suffix_array": bwt.op8_suffix_array,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_near_duplicates": minhash.op10_near_duplicates,
    "op11_timestamps": timestamps.op11_timestamps,
    "op12_alignment": alignment.op12_alignment,
    "op13_quality_rules": quality.op13_quality_rules,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op11_timestamps": timestamps.OP11_SQL,
}
