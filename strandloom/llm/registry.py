"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chroma, cotrain, jaccard, language, lbl, license, tiling, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma": chroma.op1_chroma,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_license_digests": license.op3_license_digests,
        "op4_cotraining": cotrain.op4_cotraining,
        "op5_log_bilinear": lbl.op5_log_bilinear,
        "op6_string_tiling": tiling.op6_string_tiling,
        "op7_revisits": warc.op7_revisits,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_preferences": chat.op9_preferences,
        "op10_byte_cnn": language.op10_byte_cnn,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": jaccard.ORACLE_SQL,
        "op3_license_digests": license.ORACLE_SQL,
        "op7_revisits": warc.ORACLE_SQL,
        "op9_preferences": chat.ORACLE_SQL,
    }
