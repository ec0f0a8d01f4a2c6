"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from weftline.llm import host_rules, piece_bpe, pu_quality, role_repair, secrets, set_sketch, sorted_table, style_tree, suffix_radix, tiling

QUERIES = {
    "op1_string_tiling": tiling.op1_string_tiling,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_pu_quality": pu_quality.op3_pu_quality,
    "op4_role_repair": role_repair.op4_role_repair,
    "op5_piece_bpe": piece_bpe.op5_piece_bpe,
    "op6_sorted_table": sorted_table.op6_sorted_table,
    "op7_style_tree": style_tree.op7_style_tree,
    "op8_suffix_radix": suffix_radix.op8_suffix_radix,
    "op9_host_rules": host_rules.op9_host_rules,
    "op10_set_sketch": set_sketch.op10_set_sketch,
}
ORACLE_SQL = {"op9_host_rules": host_rules.ORACLE_SQL}
