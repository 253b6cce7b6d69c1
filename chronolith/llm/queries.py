"""Queries of the training-data operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from chronolith.llm import exact_dedup, html_text, licences, near_dedup, packing, quality_rules, repeated_text, sampled_pieces, surrogates, target_resampling, token_files, toxicity, whitening

QUERIES = {
    "op1_curve_packing": packing.op1_curve_packing,
    "op2_digest_index": exact_dedup.op2_digest_index,
    "op3_line_block_text": html_text.op3_line_block_text,
    "op4_decision_list": quality_rules.op4_decision_list,
    "op5_simple8b_files": token_files.op5_simple8b_files,
    "op6_window_toxicity": toxicity.op6_window_toxicity,
    "op7_bbit_minhash": near_dedup.op7_bbit_minhash,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_bwt_repeats": repeated_text.op9_bwt_repeats,
    "op10_gumbel_segmentations": sampled_pieces.op10_gumbel_segmentations,
    "op11_digit_slice_whitening": whitening.op11_digit_slice_whitening,
    "op12_licence_scan": licences.op12_licence_scan,
    "op13_importance_resampling": target_resampling.op13_importance_resampling,
}

ORACLES = {"op2_digest_index": exact_dedup.ORACLE, "op7_bbit_minhash": near_dedup.ORACLE, "op13_importance_resampling": target_resampling.ORACLE}
