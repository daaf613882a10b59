"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, exact_dedup, lm, minhash, packing, pii, quality, resampling, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_context_tree": lm.op2_context_tree,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_warc": warc.SQL,
    "op11_resampling": resampling.SQL,
    "op12_conversation_repair": conversations.SQL,
}
