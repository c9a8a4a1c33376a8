"""All queries of the engine, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomeforge.plans import base, corpus, curating, integrity, jobs, knowledge, site, stores, validity  # noqa: F401  each registers its queries

FLAGSHIP = "corpus_catalog"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
