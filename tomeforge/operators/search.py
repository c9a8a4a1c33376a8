"""Inverted index over the search form, and search by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import search_form, search_words


def token_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, hits); partial counts come before the shuffle, so that a common token is cheap."""
    tokens = F.explode(F.split(search_form(F.col(text)), " "))
    return rows.select(key, tokens.alias("token")).where("token != ''").groupBy("token", key).agg(F.count("*").alias("hits"))


def search(index: DataFrame, key: str, query: list[str], limit: int | None = None) -> DataFrame:
    """Keys that have every token of the query, by summed hits and then key."""
    wanted = sorted({t for q in query for t in search_words(q)})
    found = index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.sum("hits").alias("score"), F.count("*").alias("n"))
    found = found.where(F.col("n") == len(wanted)).select(key, "score")
    return found.orderBy(F.desc("score"), key).limit(limit) if limit else found
