"""The queries of this subpackage and, where SQL can say it, what they must return."""

from __future__ import annotations

from . import chat_format, exact_dedup, fingerprints, near_dedup, packing, quality, source_mix, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_simhash_fingerprints": fingerprints.op4_simhash_fingerprints,
        "op5_curve_packing": packing.op5_curve_packing,
        "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_source_mix": source_mix.op10_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op3_chat_format": chat_format.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op10_source_mix": source_mix.ORACLE,
    }
