"""The queries of the training-data operators."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, hard_negatives, html_wrappers, language_id, mips, mixing, near_dedup, quality_lm, repair_tokens, secrets, substring_dedup


def queries() -> dict:
    return {
        "op1_repair_tokens": repair_tokens.op1_repair_tokens,
        "op2_randomness_secrets": secrets.op2_randomness_secrets,
        "op3_anisotropic_mips": mips.op3_anisotropic_mips,
        "op4_block_mix": mixing.op4_block_mix,
        "op5_prefix_targets": chat_format.op5_prefix_targets,
        "op6_naive_bayes_langid": language_id.op6_naive_bayes_langid,
        "op7_seeded_alignment": decontaminate.op7_seeded_alignment,
        "op8_odd_sketch_dedup": near_dedup.op8_odd_sketch_dedup,
        "op9_kneser_ney_quality": quality_lm.op9_kneser_ney_quality,
        "op10_super_kmer_dedup": substring_dedup.op10_super_kmer_dedup,
        "op11_sketch_collocations": collocations.op11_sketch_collocations,
        "op12_host_wrappers": html_wrappers.op12_host_wrappers,
        "op13_sorted_hard_negatives": hard_negatives.op13_sorted_hard_negatives,
    }


def oracle_sql() -> dict:
    return {
        "op5_prefix_targets": chat_format.ORACLE,
        "op8_odd_sketch_dedup": near_dedup.ORACLE,
        "op10_super_kmer_dedup": substring_dedup.ORACLE,
        "op11_sketch_collocations": collocations.ORACLE,
        "op13_sorted_hard_negatives": hard_negatives.ORACLE,
    }
