"""The training-data queries and their SQL, by the name under which they are registered."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, language_id, license_scan, mix_sources, quality, secret_scan, simhash_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_mix_sources": mix_sources.op4_mix_sources,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_language_id": language_id.op7_language_id,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
}

ORACLE_SQL = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_mix_sources": mix_sources.ORACLE,
}
