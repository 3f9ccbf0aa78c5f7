"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, exact_dedup, fim, language, licenses, mixing, pii, quality, secrets, simhash, urls, warc, whitening

MODULES = {
    "op6_licenses": licenses,
    "op5_secrets": secrets,
    "op1_pii": pii,
    "op3_urls": urls,
    "op7_warc": warc,
    "op9_mixing": mixing,
    "op10_language": language,
    "op2_decontaminate": decontaminate,
    "op4_simhash": simhash,
    "op8_exact_dedup": exact_dedup,
    "op11_whitening": whitening,
    "op12_quality": quality,
    "op13_fim": fim,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
