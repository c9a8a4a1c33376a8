"""The subpackage's queries and their SQL; a module is imported when its query runs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module of this subpackage, name of its SQL there if SQL can express it.
OPERATORS = [
    ("op1_secrets", "secrets", None),
    ("op2_language", "language", None),
    ("op3_near_duplicates", "near_duplicates", None),
    ("op4_licenses", "licenses", None),
    ("op5_bpe", "bpe", None),
    ("op6_neighbours", "neighbours", None),
    ("op7_main_text", "main_text", None),
    ("op8_decontaminate", "decontaminate", "OP8_SQL"),
    ("op9_line_dedup", "line_dedup", None),
    ("op10_toxicity", "toxicity", None),
    ("op11_whitening", "whitening", None),
    ("op12_hard_negatives", "hard_negatives", None),
    ("op13_packing", "packing", None),
]


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"tomeforge.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, module, _ in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"tomeforge.llm.{module}"), sql) for name, module, sql in OPERATORS if sql}
