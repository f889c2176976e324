"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from rowloom.llm import (
    chat_format,
    decontam,
    exact_dedup,
    line_dedup,
    lm_scoring,
    sentencepiece_fst,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": simhash.op1_simhash,
        "op2_sentencepiece": sentencepiece_fst.op2_sentencepiece,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_sharding": sharding.op6_sharding,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_chat_formatting": chat_format.op8_chat_formatting,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return sql | {
        "op4_decontamination": decontam.SQL,
        "op6_sharding": sharding.SQL,
        "op8_chat_formatting": chat_format.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
    }
