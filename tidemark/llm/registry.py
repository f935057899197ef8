"""Name -> query and name -> oracle SQL of this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, fingerprints, langid, lm, mixing, paragraphs, quality, sharding, simhash, spelling, toxicity, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_substring_dedup": paragraphs.op3_substring_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_url_filter": urls.op6_url_filter,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language_id": langid.op8_language_id,
        "op9_lm_scoring": lm.op9_lm_scoring,
        "op10_mixing": mixing.op10_mixing,
        "op11_sharding": sharding.op11_sharding,
        "op12_spelling": spelling.op12_spelling,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": urls.op6_sql(), "op10_mixing": mixing.OP10_SQL}
