"""Operators for large-scale training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, language, licenses, secrets, simhash, spotsigs, toxicity, url_filter, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spot_fingerprints": spotsigs.op1_spot_fingerprints,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_language_id": language.op8_language_id,
    "op9_token_counts": wordpiece.op9_token_counts,
    "op10_url_filter": url_filter.op10_url_filter,
}

#: DuckDB SQL with the same result, where SQL can express it.
ORACLE_SQL: dict[str, str] = {"op10_url_filter": url_filter.ORACLE_SQL}
