"""Queries and SQL of the corpus operators."""

from . import chat_format, decontamination, line_dedup, near_dedup, packing, period_runs, quality_rules, sharding, spelling, suffix_dedup, suffix_tree_lm, token_files, toxicity

QUERIES = {
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op8_suffix_tree_lm": suffix_tree_lm.op8_suffix_tree_lm,
    "op9_decontamination": decontamination.op9_decontamination,
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op2_sharding": sharding.op2_sharding,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op11_token_files": token_files.op11_token_files,
    "op12_periodic_runs": period_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op9_decontamination": decontamination.OP9_SQL,
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
