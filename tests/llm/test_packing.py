import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeforge.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(packing.VOCABULARY)
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def checked(rows, length=2048, documents=None, cost=None):
    """Capacities are kept and offsets have no gap; the number of sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= length
        assert documents is None or len(own) <= documents
        assert cost is None or sum(n * n for _, n in own) <= cost
    return len(sequences)


def test_ids_are_those_of_the_library_for_every_character(library):
    encode = packing._encoder(Path(PATH).read_text())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{x}1 {x}{x}b. {x}" for x in letters[at : at + 2000]) for at in range(0, len(letters), 2000)]
    assert encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b <|endoftext|>", "it's IT'S  we'll\n\n x", "<|endoftext", "\u0000\u0085᠎​", "x" * 30_000, "é 🙂👍🏽"])
def test_ids_of_odd_texts(library, text):
    assert packing._encoder(Path(PATH).read_text())([text]) == [library.encode(text, add_special_tokens=False).ids]


def test_other_vocabularies_go_to_the_library(library):
    held = json.loads(Path(PATH).read_text())
    held["model"]["merges"][0], held["model"]["merges"][5] = held["model"]["merges"][5], held["model"]["merges"][0]
    data = json.dumps(held)
    from tokenizers import Tokenizer

    texts = ["the other thing in the house", "in an inn"]
    assert packing._encoder(data)(texts) == [e.ids for e in Tokenizer.from_str(data).encode_batch(texts, add_special_tokens=False)]


def wanted(library, rows):
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [*range(first, len(ids), 2048), len(ids)], strict=True)):
            out.append((-1 if doc_id is None else doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out)


def test_query_of_the_given_table(spark, library):
    got = packing.op13_packing(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:5] for r in got) == wanted(library, rows)
    assert checked(got) <= -(-sum(r.length for r in got) // 2048) + 1


def test_odd_documents(spark, library, odd, none):
    made = packing.pieces(odd, ["doc_id", "score"], PATH)
    got = packing.packed(made.withColumn("ids_crc32", F.crc32("ids"))).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted(library, rows)
    assert {r.score for r in got} == {"other"}
    checked(got)
    whole = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == 9), key=lambda r: r.piece))
    assert np.frombuffer(whole, "<u4").tolist() == [*library.encode("long " * 60_000, add_special_tokens=False).ids, 0]
    assert packing.packed(packing.pieces(none, ["doc_id"], PATH)).count() == 0


def test_names_and_pieces_that_cannot_be(spark):
    rows = spark.createDataFrame([(1, 10)], "doc_id long, length long")
    with pytest.raises(ValueError):
        packing.packed(rows.withColumn("offset", F.lit(1)))
    with pytest.raises(ValueError):
        packing.packed(rows, length=9)
    with pytest.raises(ValueError):
        packing.packed(rows, length=20, cost=99)


@pytest.mark.parametrize("documents, cost", [(None, None), (3, None), (None, 300_000), (4, 900_000)])
def test_every_capacity_is_kept(spark, monkeypatch, documents, cost):
    monkeypatch.setattr(packing, "GROUP_PIECES", 90)
    lengths = np.random.default_rng(2).integers(1, 500, size=500).tolist() + [1] * 40 + [500] * 5
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(5)
    got = packing.packed(rows, 1024, documents, cost).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted(enumerate(lengths))
    least = max(-(-sum(lengths) // 1024), -(-len(lengths) // (documents or 1024)), -(-sum(n * n for n in lengths) // (cost or 1024 * 1024)))
    assert least <= checked(got, 1024, documents, cost) <= 1.12 * least


def test_second_round_joins_remainders(spark, monkeypatch):
    """Groups of one kind of piece each leave space that only other groups' pieces fill."""
    rows = spark.createDataFrame([(i, 700 if i % 2 else 300) for i in range(400)], "doc_id long, length long")
    alone = checked(packing.packed(rows, 1000).collect(), 1000)
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    assert alone == 200 and checked(packing.packed(rows, 1000).collect(), 1000) <= 206


def first_fit_decreasing(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, left in enumerate(bins) if left >= n), None)
        if at is None:
            bins.append(size - n)
        else:
            bins[at] -= n
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_no_more_sequences_than_first_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.integers(20, 101), size=rng.integers(1, 200))
    own = packing.packed_group(lengths, (100, 100, 10_000))
    assert np.bincount(own, weights=lengths).max() <= 100
    assert len(set(own)) <= first_fit_decreasing(lengths.tolist(), 100)


def test_rules_differ_where_resources_do():
    """Cost binds before tokens: the tightest sequence in all resources isn't the fullest one in tokens."""
    demands = np.array([[60, 1, 3600], [50, 1, 2500], [30, 1, 900], [30, 1, 900], [10, 1, 100]], dtype=float)
    size = np.array([100, 3, 5000], dtype=float)
    for rule in ("norm", "dot"):
        own, n = packing.fitted(demands, size, rule, 1.0)
        for s in range(n):
            assert (demands[own == s].sum(axis=0) <= size).all()
        assert n == 2
