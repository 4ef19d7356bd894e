"""The registered queries of this subpackage, and DuckDB SQL for those that it can express."""

import corpus_pipeline
from loreweave.llm import chat_format, conversation_repair, decontaminate, hard_negatives, language_model, licenses, packing, passage_trees, quality, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_deleted_interpolation": language_model.query,
    "op3_token_counts": token_counts.query,
    "op4_toxicity": toxicity.query,
    "op5_suffix_array_dedup": suffix_dedup.query,
    "op6_chat_format": chat_format.query,
    "op7_simhash_golay": simhash.query,
    "op8_license_scan": licenses.query,
    "op9_best_fit_packing": packing.query,
    "op10_quality_rules": quality.query,
    "op11_passage_trees": passage_trees.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_decontamination": decontaminate.SQL,
    "op8_license_scan": licenses.SQL,
    "op11_passage_trees": passage_trees.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
