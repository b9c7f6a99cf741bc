"""The registered queries of the training-data operators, and their SQL where it can say them."""

from __future__ import annotations

from quireflow.llm import bpe, chat, decontaminate, lines, lm, mixing, near, negatives, quality, rules, substring, suffix, whiten

QUERIES = {
    q.__name__: q
    for q in (
        chat.op1_chat_format,
        near.op2_minhash_dedup,
        quality.op3_quality_classifier,
        lm.op4_lm_score,
        suffix.op5_suffix_dedup,
        decontaminate.op6_decontamination,
        rules.op7_quality_rules,
        substring.op8_substring_dedup,
        bpe.op9_bpe,
        lines.op10_line_dedup,
        whiten.op11_embedding_whitening,
        negatives.op12_hard_negatives,
        mixing.op13_mixing,
    )
}

ORACLE = {
    "op1_chat_format": chat.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op10_line_dedup": lines.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
