"""The registered queries of this subpackage, with production parameters, and their SQL where there is any.

Each operator's module holds its own query function; this one only lists them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_blocks, jaccard_join, langid, related_packing, secret_forest, site_quality, token_packing, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_site_quality": site_quality.query,
        "op2_related_packing": related_packing.query,
        "op3_html_extraction": html_blocks.query,
        "op4_ngram_jaccard_join": jaccard_join.query,
        "op5_decontamination": decontaminate.query,
        "op6_language_id": langid.query,
        "op7_secret_scan": secret_forest.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_token_packing": token_packing.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_html_extraction": html_blocks.ORACLE_SQL,
        "op4_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
        "op5_decontamination": decontaminate.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
    }
