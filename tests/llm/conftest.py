import pytest

#: Rows that every operator must take: nulls, empty, blank and long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "12 34", "en", None, 5),
    (5, "word", None, "s", 4),
    (5, "word", None, "s", 4),
    (6, "日本語 テキスト", "ja", "s", 8),
    (7, "The same text of a document that stands here twice, word for word, to the end of it.", "en", "s", 80),
    (8, "The same text of a document that stands here twice, word for word, to the end of it.", "en", "s", 80),
    (9, "long " * 60_000, "en", "s", 300_000),
    (10, "x" * 200_000, "en", "s", 200_000),
    (None, "A row without an id, which has some words of its own.", "en", "s", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with more columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    for name in ("score", "kept", "n_words", "items", "class_id", "pos", "band", "clean_text", "lang_pred", "n_hit"):
        rows = rows.withColumn(name, F.lit("other"))
    return rows.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
