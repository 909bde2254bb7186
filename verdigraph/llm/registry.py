"""The training-data operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, lm, media, quality, secrets, simhash, suffix, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_lm_scores": lm.query,
        "op3_token_files": token_files.query,
        "op4_media_columns": media.query,
        "op5_quality": quality.query,
        "op6_bpe": bpe.query,
        "op7_suffix_dedup": suffix.query,
        "op8_warc": warc.query,
        "op9_decontamination": decontaminate.query,
        "op10_secrets": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.ORACLE, "op9_decontamination": decontaminate.ORACLE}
