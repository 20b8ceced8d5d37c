"""Queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, embeddings, language_id, licenses, line_dedup, ngram_join, sharding, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_warc": warc.op2_warc,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_sharding": sharding.op5_sharding,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_embedding_dedup": embeddings.op9_embedding_dedup,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {**warc.ORACLE, **embeddings.ORACLE, **url_filter.ORACLE, **line_dedup.ORACLE}
