"""The subpackage's queries, one for each operator, over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, maxent, piece_codec, quality, repeats, secrets, simhash, sorted_tables, sql, token_counts

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": lambda s, d: licenses.op1(documents(s, d)),
        "op2_repeated_strings": lambda s, d: repeats.op2(documents(s, d)),
        "op3_token_counts": lambda s, d: token_counts.op3(documents(s, d), tokenizer_file(BYTE_BPE)),
        "op4_quality_rules": lambda s, d: quality.op4(documents(s, d)),
        "op5_sorted_tables": lambda s, d: sorted_tables.op5(s, documents(s, d), tokenizer_file(BYTE_BPE)),
        "op6_piece_codec": lambda s, d: piece_codec.op6(documents(s, d), tokenizer_file(PIECE_BPE)),
        "op7_simhash": lambda s, d: simhash.op7(documents(s, d)),
        "op8_secret_scans": lambda s, d: secrets.op8(documents(s, d)),
        "op9_decontamination": lambda s, d: decontamination.op9(documents(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
        "op10_language_scores": lambda s, d: maxent.op10(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": sql.quality_rules(), "op8_secret_scans": sql.secret_scans(), "op9_decontamination": sql.decontaminated()}
