"""Queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from . import (
    decontaminate,
    language_id,
    license_scan,
    line_runs,
    packing,
    passages,
    pii,
    prefix_trie,
    quality_rules,
    secret_scan,
    simhash,
    structure_repair,
    suffix_dedup,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_packing": packing.op2_packing,
    "op3_personal_data": pii.op3_personal_data,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_line_dedup": line_runs.op6_line_dedup,
    "op7_passages": passages.op7_passages,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_language_id": language_id.op10_language_id,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_structure_repair": structure_repair.op13_structure_repair,
}

ORACLE = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_secret_scan": secret_scan.OP12_SQL,
}
