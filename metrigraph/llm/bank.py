"""Queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metrigraph.llm import chat, decontaminate, html_text, mixing, ngram_lm, quality, secrets, simhash, suffix_dedup, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_ngram_lm": ngram_lm.op3,
        "op4_mixing": mixing.op4,
        "op5_vectors": vectors.op5,
        "op6_suffix_dedup": suffix_dedup.op6,
        "op7_html_text": html_text.op7,
        "op8_secrets": secrets.op8,
        "op9_simhash": simhash.op9,
        "op10_chat": chat.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op10_chat": chat.OP10_SQL}
