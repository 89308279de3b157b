"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from skerry.llm import (
    decontamination,
    edit_fingerprints,
    jaccard_join,
    license_scan,
    paragraph_dedup,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    suffix_dedup,
    token_alignment,
    token_files,
)

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_sentencepiece_codec": sentencepiece_codec.query,
    "op3_quality_rules": quality_rules.query,
    "op4_decontamination": decontamination.query,
    "op5_sharding": sharding.query,
    "op6_token_files": token_files.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_license_scan": license_scan.query,
    "op9_paragraph_dedup": paragraph_dedup.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_token_alignment": token_alignment.query,
    "op12_edit_fingerprints": edit_fingerprints.query,
    "op13_spelling_variants": spelling_variants.query,
}

ORACLES: dict[str, str] = {
    "op5_sharding": sharding.oracle(),
    "op8_license_scan": license_scan.oracle(),
    "op13_spelling_variants": spelling_variants.oracle(),
}
