"""Queries of the text operators and the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyloom.llm import audit, chat, decontaminate, langid, licenses, linededup, mixing, ranked, rules, secrets, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_quality_rules": rules.op4_quality_rules,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_simhash_neardup": simhash.op7_simhash_neardup,
        "op8_license_scans": licenses.op8_license_scans,
        "op9_secret_scans": secrets.op9_secret_scans,
        "op10_mixing": mixing.op10_mixing,
        "op11_language_id": langid.op11_language_id,
        "op12_ranked_search": ranked.op12_ranked_search,
        "op13_filter_audit": audit.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {
        "op1_line_dedup": linededup.ORACLE_SQL,
        "op2_substring_dedup": substrings.ORACLE_SQL,
        "op4_quality_rules": rules.ORACLE_SQL,
        "op6_chat_formatting": chat.ORACLE_SQL,
        "op9_secret_scans": secrets.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
        "op12_ranked_search": ranked.ORACLE_SQL,
        "op13_filter_audit": audit.ORACLE_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in known.items() if sql is not None}
