"""The queries of this subpackage and their oracle SQL; the entry module adds the pipeline, which lies outside."""

from tallystone.llm import chat_format, decontamination, licenses, lm_scoring, near_dedup, packing, quality, sharding, topk, url_filters


def queries():
    return {
        "op1_decontamination": decontamination.query,
        "op2_near_dedup": near_dedup.query,
        "op3_chat_format": chat_format.query,
        "op4_topk": topk.query,
        "op5_url_filters": url_filters.query,
        "op6_lm_scoring": lm_scoring.query,
        "op7_license_scan": licenses.query,
        "op8_quality": quality.query,
        "op9_packing": packing.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql():
    return {
        "op1_decontamination": decontamination.ORACLE,
        "op2_near_dedup": near_dedup.ORACLE,
        "op3_chat_format": chat_format.ORACLE,
        "op4_topk": topk.ORACLE,
        "op5_url_filters": url_filters.ORACLE,
        "op6_lm_scoring": lm_scoring.ORACLE,
    }
