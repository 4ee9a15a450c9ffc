"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from spantable.llm import langid, mixing, packing, ppm, quality, simhash, tiff, topk, wavelet, wordpiece


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.query,
        "op2_exact_top_k": topk.query,
        "op3_token_counts": wordpiece.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_token_shards": wavelet.query,
        "op6_quality_classifier": quality.query,
        "op7_language_id": langid.query,
        "op8_lm_scoring": ppm.query,
        "op9_packing": packing.query,
        "op10_tiff_media": tiff.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op2_exact_top_k": topk.SQL}
