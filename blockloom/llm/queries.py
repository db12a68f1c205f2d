"""Queries of this folder, and the SQL that some of them are held against."""

from __future__ import annotations

from blockloom.llm import ball_tree, exact_dedup, fuzzy_lines, packing, prefix_bpe, pseudonyms, simhash, substring_dedup, tag_paths, toxicity

QUERIES = {
    "op1_pseudonyms": pseudonyms.op1_pseudonyms,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_tag_paths": tag_paths.op4_tag_paths,
    "op5_packing": packing.op5_packing,
    "op6_ball_tree": ball_tree.op6_ball_tree,
    "op7_prefix_bpe": prefix_bpe.op7_prefix_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_fuzzy_lines": fuzzy_lines.op9_fuzzy_lines,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_substring_dedup": substring_dedup.ORACLE, "op6_ball_tree": ball_tree.ORACLE}
