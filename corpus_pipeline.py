"""A training corpus out of `documents`, stage by stage.

Each stage takes the table that the one before has written and returns the table that it leaves; all
but the last keep the columns of `documents`. run() writes each stage's table to the shared folder,
so that a lost executor costs part of a stage at most, and deletes it when the next one is written.

Null, empty and very long texts, repeated rows and other columns are treated as each stage's operator
says; language ID drops null texts and texts without a letter. Clashing names of other columns pass
through. An empty table stays empty at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import bpe, decontaminate, language, line_dedup, near_duplicates
from tomeforge.llm.tables import free_name, removed, scratch, shared_folder, table, written

#: A document goes if the share of its likeliest language is below; with several, half is usual.
LEAST_LANGUAGE = 0.4
#: A document goes if so much of its words is benchmark text; of others the benchmark's words go.
MOST_BENCHMARK = 0.5
#: Results of BPE that a worker keeps; its memory still holds what the stages before have left.
KEPT = 100_000

#: Language ID, line dedup, benchmark decontamination and BPE can't all be told in SQL; see the tests.
ORACLE_SQL = None


def _resized(documents: DataFrame) -> DataFrame:
    """n_chars brought into line with the text."""
    return documents.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language; null texts and texts without a letter go."""
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    rows = language.identified(docs, language.fitted(docs), docs.columns, names)
    return rows.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_LANGUAGE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier place, has, compared as op9 does (ALL_LINES); a text that loses all goes."""
    rows = line_dedup.deduplicated(docs, line_dedup.ALL_LINES).select(*docs.columns)
    return _resized(rows.where("text is null or text != ''"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; what is mostly benchmark goes."""
    renamed = {c: free_name(docs, c) for c in ("n_words", "n_hit", "items", "clean_text")}
    rows = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns, clean=True, names=renamed)
    kept = rows.where(F.col(renamed["n_hit"]) <= MOST_BENCHMARK * F.col(renamed["n_words"]))
    text = F.when(F.col(renamed["n_hit"]) > 0, F.col(renamed["clean_text"])).otherwise(F.col("text"))
    return _resized(kept.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes ids and decoded bytes of each text to the shared folder; returns token counts and digests of what is written."""
    import public_tokenizers

    rows = bpe.tokens(docs, ["doc_id"], public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, KEPT)
    return bpe.digests(written(rows, "stage-bpe-tokens"), ["doc_id"])


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("benchmark", remove_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # the stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            removed(spark, last)
        docs, last = spark.read.schema(docs.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
