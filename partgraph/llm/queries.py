"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partgraph.llm import chat, decontaminate, licenses, line_dedup, matroska, mix, ngram_join, quality, secrets, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_mix_sources": mix.op2_mix_sources,
    "op3_media_columns": matroska.op3_media_columns,
    "op4_chat_format": chat.op4_chat_format,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality": quality.op6_quality,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": mix.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
}
