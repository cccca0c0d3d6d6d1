"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, fingerprint, langid, near_dup, secrets, suffix_array, suffix_tree, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": suffix_tree.op1,
        "op2_suffix_array_dedup": suffix_array.op2,
        "op3_url_filter": url_filter.op3,
        "op4_language_id": langid.op4,
        "op5_secret_scan": secrets.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_fingerprint": fingerprint.op7,
        "op8_toxicity": toxicity.op8,
        "op9_bpe": bpe.op9,
        "op10_near_dup": near_dup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": suffix_tree.SQL, "op6_decontamination": decontaminate.SQL, "op10_near_dup": near_dup.SQL}
