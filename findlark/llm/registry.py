"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, extraction, langid, ngramlm, packing, quality, secrets, simjoin, toxicity

QUERIES = {
    "op1_html_extraction": extraction.query,
    "op2_best_fit_packing": packing.query,
    "op3_language_id": langid.query,
    "op4_secret_scan": secrets.query,
    "op5_quality_rules": quality.query,
    "op6_ngram_jaccard": simjoin.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_format": chat.query,
    "op9_decontamination": decontam.query,
    "op10_lm_scoring": ngramlm.query,
}

ORACLES = {
    "op6_ngram_jaccard": simjoin.ORACLE,
    "op8_chat_format": chat.ORACLE,
}
