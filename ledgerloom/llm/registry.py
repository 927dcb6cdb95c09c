"""The subpackage's queries, and SQL for those that SQL can express."""

import corpus_pipeline
from ledgerloom.llm import chat, fingerprints, hardneg, importance, language, licenses, mixing, packing, quality, repetition, simhash, topk, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_warc_derivatives": warc.op4_warc_derivatives,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language.op6_language_id,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_mixing_sources": mixing.op9_mixing_sources,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_suffix_repetition": repetition.op11_suffix_repetition,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_exact_top_k": topk.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op4_warc_derivatives": warc.OP4_SQL,
    "op11_suffix_repetition": repetition.OP11_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
