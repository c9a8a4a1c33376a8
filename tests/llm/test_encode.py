import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tomeforge.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
RANKS = bpe.read_ranks(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_as_the_library_encodes(library):
    rng, pieces = random.Random(3), bpe.Pieces(bpe.Bpe(RANKS), public_tokenizers.PATTERN)
    alphabet = "ab cZé  \n\t\r\x1c\x85 'stll'd129²½ª,.!?-\0　漢字🎉́ ñ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["ab" * 9000, "a" * 5000, "ünïcödé" * 700, " " * 300]
    for text in texts:
        parts = pieces.of(text)
        ids = np.frombuffer(b"".join(p[0] for p in parts), np.int32).tolist()
        assert ids == library.encode_ordinary(text)
        assert b"".join(p[1] for p in parts) == text.encode()


def test_join_is_associative_over_cuts(library):
    own, data = bpe.Bpe(RANKS), "antidisestablishmentarianism-überraschungsgefühl".encode()
    whole = own.merged(data)
    for cut in range(len(data) + 1):
        assert own.join(own.reduced(data[:cut]), own.reduced(data[cut:])) == whole
    assert own.decode(whole) == data


def test_long_windows_merge_alike():
    rng, own = random.Random(5), bpe.Bpe(RANKS)
    for _ in range(2000):
        data = "".join(rng.choice("aabc =日é") for _ in range(rng.randint(1, 60))).encode()
        assert own.merged_long(data) == own.merged(data) == own.reduced(data)


def test_very_long_runs():
    """Matches of a million bytes: as the definition merges them, which a heap does in n log n."""
    own = bpe.Bpe(RANKS)
    for data in (b"a" * 1_000_000, b"=" * 300_001, b"ab" * 100_000 + b"a" * 77_777, "字".encode() * 100_000):
        ids = own.encode(data)
        assert ids == own.merged_long(data) and own.decode(ids) == data


def test_op5_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op5_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd, none, library):
    got = bpe.encoded(odd, ["doc_id", "text"], PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encoded(none, ["doc_id"], PATH, public_tokenizers.PATTERN).count() == 0


def test_tokens_are_kept(spark, odd, none, library):
    short = odd.where("length(text) < 1000 or text is null")  # the library is slow on long pieces
    for r in bpe.tokens(short, ["doc_id", "text"], PATH, public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.tokens(none, ["doc_id"], PATH, public_tokenizers.PATTERN).count() == 0


def test_the_pipeline_writes_ids(spark, odd, library):
    import glob

    import corpus_pipeline
    from tomeforge.llm.tables import shared_folder

    pattern = f"{shared_folder(spark).removeprefix('file:')}/stage-bpe-tokens-*"
    before = set(glob.glob(pattern))
    docs = odd.where("doc_id = 7")
    assert corpus_pipeline.encode(spark, docs, "").count() == 1
    (path,) = set(glob.glob(pattern)) - before
    (r,) = spark.read.parquet(path).collect()
    assert r.ids == library.encode_ordinary(docs.first().text) and bytes(r.decoded).decode() == docs.first().text
