"""The corpus operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fingerprint, jaccard, langid, lexical, licenses, mixing, packing, phrases, pii, quality, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_language_id": langid.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_mixing": mixing.op10_mixing,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_collocations": phrases.op13_collocations,
    "fingerprint_near_copies": fingerprint.fingerprint_near_copies,  # op9's bands and verified links
}
ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op11_license_scan": licenses.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_collocations": phrases.SQL,
}
