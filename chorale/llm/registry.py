"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from chorale.llm import bpe, chat, decontamination, exact_dedup, lm_scoring, near_dedup, quality, secrets, token_counts, warc


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1,
        "op2_quality_classifier": quality.op2,
        "op3_chat_formatting": chat.op3,
        "op4_minhash_near_dedup": near_dedup.op4,
        "op5_exact_dedup": exact_dedup.op5,
        "op6_bpe_round_trip": bpe.op6,
        "op7_lm_scoring": lm_scoring.op7,
        "op8_warc_round_trip": warc.op8,
        "op9_token_counts": token_counts.op9,
        "op10_benchmark_decontamination": decontamination.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.ORACLE_SQL,
        "op3_chat_formatting": chat.ORACLE_SQL,
        "op4_minhash_near_dedup": near_dedup.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_warc_round_trip": warc.ORACLE_SQL,
        "op10_benchmark_decontamination": decontamination.ORACLE_SQL,
    }
