"""The corpus queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe_codec, conversations, decontam, lexical_search, media, pii, quality, secrets, simhash, sql, token_count, token_files, toxicity, url_filter


def queries():
    return {
        "op1_token_counts": token_count.op1_token_counts,
        "op2_benchmark_decontamination": decontam.op2_benchmark_decontamination,
        "op3_bpe_codec": bpe_codec.op3_bpe_codec,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_media_columns": media.op6_media_columns,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_personal_data": pii.op9_personal_data,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_token_files": token_files.op12_token_files,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
