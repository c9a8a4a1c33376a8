import corpus_pipeline
from pyspark.sql import functions as F

from tomeforge.llm import line_dedup
from tests.llm.test_duplicates import hits, kept_lines, near_classes

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark):
    """Each stage on what the one before has left, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").limit(120)
    docs = docs.union(spark.createDataFrame([(900_001, None, "en", "s", None), (900_002, "12 34 !!", "en", "s", 8)], docs.schema)).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF).cache()
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (held, out))
        if name == "language":
            assert not {900_001, 900_002} & set(after) and len(after) >= len(before) - 3
        elif name == "lines":
            assert after == {d: t for d, t in kept_lines(list(before.items()), line_dedup.ALL_LINES).items() if t}
        elif name == "near_duplicates":
            assert set(after) == set(near_classes(list(before.items())).values())
        else:
            for d, text in before.items():
                n_words, n_hit, _ = hits(text, items)
                assert (d in after) == (n_hit <= 0.5 * n_words)
                assert d not in after or hits(after[d], items)[1] == 0 and (n_hit or after[d] == text)
        assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        held = out
    last = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert last.count() == held.count() and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "bpe"]
