"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from graphloom.llm import chat, decontaminate, fingerprint, merkle, ngram_join, packing, pii, quality, runs, secrets, sharding, substring_dedup, toxicity

QUERIES: dict = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_document_fingerprints": fingerprint.op7_document_fingerprints,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op9_pii": pii.op9_pii,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_sharding": sharding.op12_sharding,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLES: dict = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_ngram_jaccard_join": ngram_join.OP8_SQL,
    "op10_secret_scans": secrets.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
}
