"""Queries of the training-data operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from . import exact, fingerprint, langid, linededup, mixing, packing, pii, simhash, toxicity, urlrules

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "op2_language_id": langid.op2,
    "op3_url_filters": urlrules.op3,
    "op4_packing": packing.op4,
    "op5_line_dedup": linededup.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_toxicity": toxicity.op7,
    "op8_pii_pseudonyms": pii.op8,
    "op9_exact_dedup": exact.op9,
    "op10_document_fingerprints": fingerprint.op10,
}

ORACLES = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op3_url_filters": urlrules.OP3_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
}
